"""Session defaults: UTC, adaptive execution, and shuffle partitions left to the cluster's setting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build(master: str | None = None, name: str = "millrace", **conf) -> SparkSession:
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (base | {k.replace("_", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see. Where it is unset, a temporary one in
    local mode (as in tests), and an error on a cluster, whose executors wouldn't see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="shared")


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
