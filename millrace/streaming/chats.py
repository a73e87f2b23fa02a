"""Streamed chats: turns with timers, prompts joined with responses, and turns saved to three stores.

A turn's lines become text in keyed state that a timer ends and a time to live removes; prompts meet responses in a
join of two streams within a watermark; what is ended is written as chats with vectors, index entries, and a segment
of the stored search index, each of which takes a batch that runs again in place of what it wrote.
"""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from millrace.functions import vector as V
from millrace.operators import chat, index
from millrace.sources import files
from millrace.streaming.turns import OUT

WEIGHTS = {"prompt": 2.0, "response": 0.75, "model_name": 1.0}
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Turn(StatefulProcessor):
    """One turn: its text so far, until it ends or has been silent for silent_ms. That it has ended is known for
    another keep_ms, in which lines that come late are left out; then its state goes."""

    def __init__(self, silent_ms: int, keep_ms: int):
        self.silent_ms, self.keep_ms = silent_ms, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", "text string, done boolean", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):
        text, done = self.turn.get() if self.turn.exists() else ("", False)
        frame, status = pd.concat(list(rows)).sort_values("seq"), None
        for content, finish, failed in zip(frame["content"], frame["finish"], frame["failed"]):
            if done:
                break
            if failed:
                status = "error"
            else:
                text += content or ""
                if isinstance(finish, str) and finish:
                    status = "complete" if finish in ("stop", "length") else "error"
            done = status is not None
        self._wait(None if done else timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)
        self.turn.update(("" if done else text, done))
        if status:
            yield pd.DataFrame([(key[0], text, status)], columns=["turn_id", "text", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        text, done = self.turn.get() if self.turn.exists() else ("", True)
        if not done:
            self.turn.update(("", True))
            yield pd.DataFrame([(key[0], text, "timeout")], columns=["turn_id", "text", "status"])

    def _wait(self, until: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if until is not None:
            self.handle.registerTimer(until)

    def close(self) -> None:
        pass


def ended(lines: DataFrame, silent_ms: int = 60_000, keep_ms: int = 3_600_000) -> DataFrame:
    """lines(turn_id, seq, line), a stream of events, as a stream of ended turns (turn_id, text, status): complete,
    error or timeout, each once. Lines of one turn must come in order of their batches. State is bounded by the
    turns that are open or ended less than keep_ms ago. Needs the RocksDB state store, which it sets in the session."""
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    e = lines.select(F.col("turn_id").cast("string").alias("turn_id"), "seq", chat.parse_event("line").alias("e")).where("e is not null and turn_id is not null").select("turn_id", "seq", "e.*")
    return e.groupBy("turn_id").transformWithStateInPandas(Turn(silent_ms, keep_ms), OUT, "Append", "ProcessingTime")


def paired(prompts: DataFrame, responses: DataFrame, within: str = "10 minutes", late: str = "5 minutes", key: str = "turn_id") -> DataFrame:
    """prompts(key, sent, ...) with the responses(key, ended, ...) that end within that time of them.

    Both may be streams: rows later than the watermark are left out, and state holds what may still be met.
    A prompt without a response, a response without a prompt and null keys give no row; repeated keys give each pair.
    """
    p, r = prompts.withWatermark("sent", late), responses.withWatermark("ended", late).withColumnRenamed(key, "__key")
    return p.join(r, (F.col(key) == F.col("__key")) & (F.col("ended") >= F.col("sent")) & (F.col("ended") <= F.col("sent") + F.expr(f"interval {within}"))).drop("__key")


def save(turns: DataFrame, base: str, checkpoint: str, embed, size: int = 768):
    """A writer of turns(id, prompt, response, model_name, ended) to three stores under base: ``chats`` (with the
    vector of the turn as a blob), ``entries`` of the document index under "id-time", and ``search``, a stored
    index (millrace.operators.index). A batch has its own part of the first two, and overwrites by id in the
    third, so that one that runs again leaves each turn once. embed: list of texts -> list of vectors."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark, folder = batch.sparkSession, f"epoch={epoch}"
        rows = batch.select("id", "prompt", "response", "model_name", "ended")
        chats, entries = chat.saved(rows, F.col("ended"))
        made = files.embedded(chats, "embedded_text", embed, size).withColumn("embedding", V.to_blob(F.col("vector").cast("array<double>")))
        made.select("id", "prompt", "response", "model_name", "embedding").write.mode("overwrite").parquet(f"{base}/chats/{folder}")
        # What was embedded is read back: the source of a batch is asked once for its vectors.
        saved = spark.read.parquet(f"{base}/chats/{folder}").select("id", "prompt", "response", "model_name")
        entries.write.mode("overwrite").parquet(f"{base}/entries/{folder}")
        known = opened(spark, f"{base}/search")
        if known:
            index.append(known, saved)
        else:
            index.create(saved, "id", WEIGHTS, f"{base}/search")

    return turns.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")


def opened(spark: SparkSession, path: str) -> index.Index | None:
    """The stored index at a path; None where there is none yet."""
    try:
        return index.Index(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
