"""Importance resampling towards a target: documents drawn by the likelihood ratio of their hashed n-grams.

N-grams come from a position table: words are posexploded, and for each order a window's lead() over the
document sets the following words behind each one. Their hashes are counted by bucket in the target and
in the raw corpus; a bucket's gain is the logarithm of the ratio of its smoothed shares. A document's
weight is the mean gain of its n-grams; a Gumbel draw seeded by its id is added, and the best scores win.

Texts are dealt by row once, so that positions, windows and sums of a document stay where it is; only
counts and gains of the buckets, a bounded table, go to all tasks.

Defined results: null and wordless texts have no features, weight 0 and a score, and can't be drawn; a null
doc_id is an empty string in the seed and comes first among ties; repeated rows each get their row
and count each; rows with equal score and id take their ranks in any order; an empty target or corpus has
counts of 0; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import checkpoint, numbered

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDERS, BUCKETS, LEAST_WORDS, SHARE, SEED = 2, 10_000, 20, 25, 7


def features(docs: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(rid, doc_id, nth, bucket): the n-grams of orders 1 (nth = 0), 2, ... at each position; at the end of a
    text and for texts without words bucket is null."""
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    dealt = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("rid")).repartition("rid")
    table = dealt.select("rid", "doc_id", F.posexplode_outer(words).alias("pos", "word"))
    by = Window.partitionBy("rid").orderBy("pos")
    table = table.select("rid", "doc_id", "word", *(F.lead("word", k).over(by).alias(f"next{k}") for k in range(1, orders)))
    grams, hashes = F.col("word"), []
    for k in range(orders):
        grams = grams if k == 0 else F.concat(grams, F.lit(" "), F.col(f"next{k}"))
        hashes.append((F.crc32(grams.cast("binary")) % buckets).cast("int"))
    return table.select("rid", "doc_id", F.posexplode(F.array(*hashes)).alias("nth", "bucket"))


def counts(found: DataFrame) -> DataFrame:
    """(bucket, n): at most as many rows as there are buckets."""
    return found.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket, in thousandths of a nat, from the counts of both sides."""
    spark = raw.sparkSession
    both = checkpoint(raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    g = both.unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    whole = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    up = (F.col("t") + 1).cast("double") * F.lit(float(whole.s + buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(whole.t + buckets))
    return g.select("bucket", F.floor(F.log(up / down) * 1000).alias("gain"))


def gumbel(seed: int) -> F.Column:
    """A Gumbel draw that follows from the id, in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000)


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST_WORDS, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs. rank is the place of a drawn one: share
    percent of the documents with ``least`` words or more are drawn."""
    found = features(docs, orders, buckets)
    given = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), orders, buckets)
    g = gains(counts(found), counts(given), buckets)
    # The gains are one row a bucket: a bound that no corpus moves.
    scored = found.join(F.broadcast(g), "bucket", "left").groupBy("rid", "doc_id").agg(
        F.count("bucket").alias("n_features"), F.count_if((F.col("nth") == 0) & F.col("bucket").isNotNull()).alias("n_words"), F.sum("gain").alias("total")
    )
    weight = F.when(F.col("n_features") > 0, F.floor(F.col("total") / F.col("n_features"))).otherwise(0)
    scored = scored.select("doc_id", "n_features", weight.alias("weight"), (F.col("n_words") < least).alias("short"))
    scored = scored.withColumn("score", F.col("weight") + gumbel(seed)).withColumn("down", -F.col("score"))
    drawn = ~F.col("short") & (F.col("at") < F.floor(F.col("n") * share / 100))
    # Dealing by range reads its input twice: once for the bounds.
    return numbered(checkpoint(scored), ["short"], ["down", "doc_id"]).select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("at") + 1).alias("rank"))
