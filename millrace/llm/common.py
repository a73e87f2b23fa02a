"""Helpers that the corpus operators share: table access, checkpoints and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, the separator of words in most contracts.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see. Where it is unset, a temporary one in
    local mode (as in tests), and an error on a cluster, whose executors wouldn't see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="ckpt")


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that a lost executor costs no lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: smaller than a checkpoint where columns repeat themselves."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df with at, the place of a row in its group from 0 on (nulls first, equal rows in any order), and n, the
    group's rows.

    Rows are dealt by range over group, order and a row number, so that neither a group nor a key has to
    fit a task; a window only sees one row for each group in each partition.
    """
    by = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    tied = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*by, F.col("__tie"))
    put = checkpoint(tied.sortWithinPartitions(*by, F.col("__tie")).drop("__tie").withColumn("__row", F.monotonically_increasing_id()))
    put = put.withColumn("__part", F.shiftright("__row", 33))
    runs = put.groupBy(*group, "__part").agg(F.min("__row").alias("__first"), F.count("*").alias("__size"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*(F.col(g).alias(f"__{g}") for g in group), F.col("__part").alias("__p"), (F.coalesce(F.sum("__size").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__size").over(whole).alias("n"))
    same = F.col("__part") == F.col("__p")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"__{g}"))
    return put.join(runs.hint("merge"), same).select(*df.columns, (F.col("__row") + F.col("__shift")).alias("at"), "n")


def words(text) -> F.Column:
    """Words between ASCII white space, as an array; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS), lambda w: w != "")


def let(value, body):
    """body(value) with value computed once: a lambda variable cannot be inlined by the optimiser."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slices(column, most: int = 4 << 20):
    """Parts of an Arrow column of texts, each of up to ``most`` bytes (or of one text that has more), so
    that a worker's memory doesn't follow the length of documents."""
    import pyarrow.compute as pc

    at, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if size + n > most and i > at:
            yield column[at:i]
            at, size = i, 0
        size += n
    if len(column) > at:
        yield column[at:]


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges(a, b); root is the smallest vertex of its component.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the edge set stops
    changing. A hub costs one aggregated row per map task, never a gathered neighbour list; each
    round is checkpointed. No edges, no rows. Nulls must have been removed.
    """
    e = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = e.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first()
        if not now[0] or now == state:
            break
        state = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = checkpoint(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
    roots = e.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(roots)
