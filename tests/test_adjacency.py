"""The compacted adjacency against the whole log."""

import contextlib
import io
import random

from pyspark.sql import functions as F

from millrace.operators import adjacency, graph

SCHEMA = "src long, dst long, version long, is_deleted boolean"


def log(seed, n, lo, hi):
    rnd = random.Random(seed)
    return [(rnd.choice([0, 0, 0, *range(9)]), rnd.randrange(12), rnd.randrange(lo, hi), rnd.random() < 0.3) for _ in range(n)]


def rows(df):
    return sorted(map(tuple, df.select("src", "dst").collect()), key=str)


def test_as_the_log_at_three_cutoffs(spark, monkeypatch):
    parts = [log(1, 120, 0, 50), log(2, 60, 40, 80), log(3, 60, 60, 120)]  # later parts hold entries that come late
    whole = spark.createDataFrame(parts[0], SCHEMA)
    adjacency.compact(whole, "adj_0", buckets=4)
    for i, part in enumerate(parts[1:], 1):
        delta = spark.createDataFrame(part, SCHEMA)
        whole = whole.unionByName(delta)
        want = rows(graph.active(whole))
        for small in (0, 1000):  # dealt like the buckets, and broadcast
            monkeypatch.setattr(adjacency, "SMALL", small)
            assert rows(adjacency.active(spark, f"adj_{i - 1}", delta)) == want
        for v in (0, 3, 99):
            assert sorted(r.dst for r in adjacency.neighbors(spark, f"adj_{i - 1}", v, delta).collect()) == sorted(r.dst for r in graph.neighbors(whole, v).collect())
        adjacency.merged(spark, f"adj_{i - 1}", delta, f"adj_{i}", cutoff=40)
        assert rows(adjacency.active(spark, f"adj_{i}")) == want
        assert spark.table(f"adj_{i}").where("is_deleted and version < 40").count() == 0
    assert sorted(r.dst for r in adjacency.common(spark, "adj_2", 0, 3).collect()) == sorted(r.dst for r in graph.common_neighbors(whole, 0, 3).collect())


def test_plans(spark):
    edges = spark.range(2000).select((F.col("id") % 100).alias("src"), F.col("id").alias("dst"), F.col("id").alias("version"), F.lit(False).alias("is_deleted"))
    adjacency.compact(edges, "adj_plan", buckets=8)

    def plan(df):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain("formatted")
        return out.getvalue()

    # Otherwise the planner prunes buckets without saying so.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    one = plan(adjacency.neighbors(spark, "adj_plan", 7))
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 8" in one and "Exchange" not in one
    spark.range(100).select("id", F.lit("x").alias("name")).write.bucketBy(8, "id").sortBy("id").mode("overwrite").saveAsTable("adj_vertices")
    joined = adjacency.described(spark, "adj_plan", "adj_vertices", "id")
    assert "Exchange" not in plan(joined) and joined.count() == 2000
    delta = edges.limit(5).withColumn("version", F.col("version") + 5000)
    assert adjacency.active(spark, "adj_plan", delta).count() == 2000


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    adjacency.compact(none, "adj_none", buckets=2)
    assert rows(adjacency.active(spark, "adj_none", none)) == []
    nulls = spark.createDataFrame([(None, 1, 1, False), (None, 1, 1, False), (2, None, 1, False)], SCHEMA)
    adjacency.merged(spark, "adj_none", nulls, "adj_nulls")
    assert rows(adjacency.active(spark, "adj_nulls")) == rows(graph.active(nulls))
    assert rows(adjacency.active(spark, "adj_nulls", nulls.withColumn("is_deleted", F.lit(True)).withColumn("version", F.lit(2)))) == []
