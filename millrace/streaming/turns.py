"""Streaming: deltas of completions accumulated to turns, and turns written to their tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators import chat, search

OUT = "turn_id string, text string, status string"
MESSAGE = "chat_message string, role_instructions string, model string, HEADERS map<string,string>"


def _step(key, batches, state: GroupState, silent_ms: int | None):
    """One turn: text so far is its state. A turn is given once, when it ends or its time is up."""
    if state.hasTimedOut:
        text = state.get[0]
        state.remove()
        yield pd.DataFrame([(key[0], text, "timeout")], columns=["turn_id", "text", "status"])
        return
    text, done = state.get if state.exists else ("", False)
    rows = pd.concat(list(batches)).sort_values("seq")
    status = None
    for content, finish, failed in zip(rows["content"], rows["finish"], rows["failed"]):
        if done:
            break
        if failed:
            status = "error"
        else:
            text += content or ""
            if isinstance(finish, str) and finish:
                status = "complete" if finish in ("stop", "length") else "error"
        done = status is not None
    state.update((text, done))
    if silent_ms:
        state.setTimeoutDuration(silent_ms)
    if status:
        yield pd.DataFrame([(key[0], text, status)], columns=["turn_id", "text", "status"])


def accumulate(lines: DataFrame, silent_ms: int | None = 60_000) -> DataFrame:
    """lines(turn_id, seq, line), a stream of events, as a stream of ended turns (turn_id, text, status).

    Lines of one turn must come in order of their batches. A turn that is silent for silent_ms ends as
    timed out, so state is bounded by the turns that are open or have just ended; such a query runs on
    and on. None, for replays that end with their input, keeps the state of every turn.
    """

    def run(key, batches, state):
        if state.hasTimedOut and state.get[1]:
            state.remove()  # given already
            return
        yield from _step(key, batches, state, silent_ms)

    e = lines.select(F.col("turn_id").cast("string").alias("turn_id"), "seq", chat.parse_event("line").alias("e")).where("e is not null").select("turn_id", "seq", "e.*")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if silent_ms else GroupStateTimeout.NoTimeout
    return e.groupBy("turn_id").applyInPandasWithState(run, OUT, "text string, done boolean", "append", timeout)


def messages(spark: SparkSession, path: str) -> DataFrame:
    """Chat messages from JSON files as they come."""
    return spark.readStream.schema(MESSAGE).json(path)


def save_turns(turns: DataFrame, base: str, checkpoint: str):
    """Writes ended turns to chats and to the postings of the search index, batch by batch; a batch that is
    run again replaces what it wrote."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{base}/chats/epoch={epoch}")
        search.postings(batch, "turn_id", {"text": 1.0}).write.mode("overwrite").parquet(f"{base}/postings/epoch={epoch}")
        batch.unpersist()

    return turns.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events a window and type, late ones within the watermark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")
