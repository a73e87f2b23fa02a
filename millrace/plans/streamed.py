"""Named queries that run over streams: tables are written as files, read as streams, and their results as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.functions import vector as V
from millrace.operators import chat, index
from millrace.plans.catalog import PAIRS, TOKENS, _chats, query
from millrace.session import shared_folder, table
from millrace.streaming import chats

TIME = "2024-01-02 03:04:05"


def _folder(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _stream(df, path):
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def _finished(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()


@query(f"SELECT conv_id, turn, prompt, response, 'm/' || conv_id % 3 || '/2' AS path FROM ({PAIRS})")
def stream_pairs(spark, d):
    """Prompts that meet their responses and the model that was added last, stream by stream and table."""
    t, base = table(spark, d, "conversations"), _folder(spark, "pairs")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 60 + F.col("turn"))  # a watermark begins at 1970
    asked = t.where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), "conv_id", "turn", F.col("text").alias("prompt"), F.concat(F.lit("m"), F.col("conv_id") % 3).alias("model"), at.alias("sent"))
    given = t.where("role = 'assistant'").select(F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("turn_id"), F.col("text").alias("response"), at.alias("ended"))
    # Three models, each added three times: the path of the last one counts.
    models = t.select((F.col("conv_id") % 3).alias("m"), (F.col("turn") % 3).alias("id")).distinct().select(F.concat(F.lit("m"), "m").alias("name"), "id", F.concat(F.lit("m/"), "m", F.lit("/"), "id").alias("path"))
    met = chats.paired(_stream(asked, f"{base}/asked"), _stream(given, f"{base}/given"))
    out = chat.model_paths(met, models).select("conv_id", "turn", "prompt", "response", "path")
    _finished(out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint"))
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@query(f"""SELECT conv_id * 1000 + turn AS id, CAST(length('User: ' || prompt || chr(10) || 'Assistant: ' || response) AS DOUBLE) AS embedded, prompt || chr(10) || response AS body,
(conv_id * 1000 + turn) || '-2024-01-02T03:04:05Z' AS entry_id, list_contains({TOKENS.format("prompt")}, 'the') OR list_contains({TOKENS.format("response")}, 'the') AS found FROM ({PAIRS})""")
def streamed_turns(spark, d):
    """Turns saved from a stream: their vectors, their index entries, and what the search index finds of them."""
    base = _folder(spark, "turns")
    turns = _chats(spark, d).withColumn("ended", F.lit(TIME).cast("timestamp"))
    _finished(chats.save(_stream(turns, f"{base}/in"), f"{base}/db", f"{base}/checkpoint", lambda texts: [[float(len(t)), 1.0] for t in texts], size=2))
    saved = spark.read.parquet(f"{base}/db/chats").select("id", V.from_blob("embedding")[0].alias("embedded"))
    entries = spark.read.parquet(f"{base}/db/entries").select(F.split_part("id", F.lit("-"), F.lit(1)).cast("long").alias("id"), "body", F.col("id").alias("entry_id"))
    hits = index.Index(spark, f"{base}/db/search").match("the").select(F.col("row_id").alias("id"), F.lit(True).alias("hit"))
    return saved.join(entries, "id").join(hits, "id", "left").select("id", "embedded", "body", "entry_id", F.coalesce("hit", F.lit(False)).alias("found"))
