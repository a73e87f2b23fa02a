"""Compacted adjacency: the current edges of a log as a bucketed table, and a small log of later changes.

The table is bucketed by src and sorted by (src, dst): a vertex's neighbours are read from one bucket, and joins of
adjacencies by src need no exchange. Changes are a log (graph.add_edges, graph.remove_edges) that is merged
into the next table at a cutoff, where tombstones older than that go.

Defined results: as graph.active over the whole log; null vertices are edges like others; repeated entries
count once; an empty log makes an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import graph

#: Entries of a delta up to which it is broadcast to the buckets.
SMALL = 100_000


def compact(log: DataFrame, name: str, buckets: int = 16, cutoff: int | None = None, path: str | None = None) -> None:
    """Writes the last entry of each edge of a log as the table ``name`` (at ``path``, if given); of tombstones those
    from cutoff on stay, so that older changes that come late don't revive an edge."""
    kept = graph.current(log) if cutoff is None else graph.collect_garbage(log, cutoff)
    out = kept.select("src", "dst", "version", "is_deleted").repartition(buckets, "src").write.bucketBy(buckets, "src").sortBy("src", "dst").mode("overwrite")
    (out.option("path", path) if path else out).saveAsTable(name)


def entries(spark: SparkSession, name: str, delta: DataFrame | None = None) -> DataFrame:
    """The last entry of every edge of the table and a delta(src, dst, version, is_deleted).

    The table isn't aggregated nor shuffled: of its rows only those go that an entry of the delta follows. A small
    delta is sent to the buckets; a larger one is dealt as they are.
    """
    base = spark.table(name)
    if delta is None:
        return base
    last = graph.current(delta).select("src", "dst", "version", "is_deleted")
    few = last.limit(SMALL + 1).count() <= SMALL
    newer = last.select(F.col("src").alias("__s"), F.col("dst").alias("__d"), F.col("version").alias("__v"), F.col("is_deleted").alias("__x"))
    same = F.col("src").eqNullSafe(F.col("__s")) & F.col("dst").eqNullSafe(F.col("__d"))
    ahead = (F.col("__v") > F.col("version")) | ((F.col("__v") == F.col("version")) & (F.col("__x") | ~F.col("is_deleted")))
    kept = base.join(F.broadcast(newer) if few else newer.hint("merge"), same & ahead, "left_anti")
    # An entry of the delta that comes late is behind the table's own.
    behind = last.join(named(base.join(F.broadcast(last.select("src", "dst")) if few else last.select("src", "dst").hint("merge"), ["src", "dst"], "left_semi")), same & ~ahead_of(), "left_anti")
    return kept.unionByName(behind)


def named(base: DataFrame) -> DataFrame:
    return base.select(F.col("src").alias("__s"), F.col("dst").alias("__d"), F.col("version").alias("__v"), F.col("is_deleted").alias("__x"))


def ahead_of():
    """Whether an entry follows the table's own (__v, __x) or repeats it."""
    return (F.col("version") > F.col("__v")) | ((F.col("version") == F.col("__v")) & (F.col("is_deleted") | ~F.col("__x")))


def active(spark: SparkSession, name: str, delta: DataFrame | None = None) -> DataFrame:
    return entries(spark, name, delta).where(~F.col("is_deleted"))


def neighbors(spark: SparkSession, name: str, src, delta: DataFrame | None = None) -> DataFrame:
    """(dst) of one vertex, from its bucket and its entries of the delta."""
    own = spark.table(name).where(F.col("src") == src)
    if delta is None:
        return own.where(~F.col("is_deleted")).select("dst")
    log = own.unionByName(delta.where(F.col("src") == src).select("src", "dst", "version", "is_deleted"))
    return graph.active(log).select("dst")


def common(spark: SparkSession, name: str, a, b) -> DataFrame:
    """(dst) of two vertices' common neighbours, from their two buckets."""
    one, other = (spark.table(name).where((F.col("src") == x) & ~F.col("is_deleted")).select("dst").distinct() for x in (a, b))
    return one.join(other, "dst")


def described(spark: SparkSession, name: str, vertices: str, key: str) -> DataFrame:
    """Active edges with the columns of their src in another table bucketed alike: no exchange."""
    v = spark.table(vertices)
    return spark.table(name).where(~F.col("is_deleted")).join(v.hint("merge"), F.col("src") == v[key])


def merged(spark: SparkSession, name: str, delta: DataFrame, into: str, cutoff: int | None = None, path: str | None = None) -> None:
    """The next table: the old one and a delta, tombstones older than cutoff gone. It is another table, so that
    readers of the old one are not disturbed; bucketed as that is."""
    buckets = int(next(r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect() if r.col_name == "Num Buckets"))
    compact(entries(spark, name, delta), into, buckets, cutoff, path)
