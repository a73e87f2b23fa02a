"""Graphs: a versioned edge log, neighbours, reachability, dense ids and a property graph."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.tables import latest, numbered
from millrace.session import checkpoint


def add_edges(log: DataFrame, edges: DataFrame, version: int) -> DataFrame:
    """log with edges (src, dst) as of version; an edge that was deleted lives again."""
    return log.unionByName(edges.select("src", "dst", F.lit(version).cast("long").alias("version"), F.lit(False).alias("is_deleted")))


def remove_edges(log: DataFrame, edges: DataFrame, version: int) -> DataFrame:
    """log with tombstones for those of the edges that are there."""
    there = edges.select("src", "dst").join(active(log), ["src", "dst"], "left_semi").distinct()
    return log.unionByName(there.select("src", "dst", F.lit(version).cast("long").alias("version"), F.lit(True).alias("is_deleted")))


def current(log: DataFrame, as_of=None) -> DataFrame:
    """The last entry of every edge, tombstones included, up to a version if given. Of entries with one
    version a deletion is last."""
    seen = log if as_of is None else log.where(F.col("version") <= as_of)
    return latest(seen, ["src", "dst"], "version", "is_deleted")


def active(log: DataFrame, as_of=None) -> DataFrame:
    return current(log, as_of).where(~F.col("is_deleted"))


def find_edge(log: DataFrame, src, dst) -> DataFrame:
    return current(log.where((F.col("src") == src) & (F.col("dst") == dst)))


def neighbors(log: DataFrame, src, as_of=None) -> DataFrame:
    """(dst) of one vertex; its entries are filtered in the scan."""
    return active(log.where(F.col("src") == src), as_of).select("dst")


def neighbors_in_order(log: DataFrame, src, as_of=None) -> DataFrame:
    """(dst, seen) of one vertex in the order in which the log first names them, at either end of an edge."""
    mine = neighbors(log, src, as_of)
    named = log.select(F.explode(F.array(F.struct(F.col("src").alias("dst"), "version"), F.struct("dst", "version"))).alias("v")).select("v.*")
    seen = named.join(mine, "dst", "left_semi").groupBy("dst").agg(F.min("version").alias("seen"))
    return mine.join(seen, "dst").orderBy("seen", "dst")


def link_documents(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(id, document_id) and edges(from_id, to_id) with an edge for each of pairs(from_document,
    to_document); documents without a node get one."""
    ids = pairs.select(F.explode(F.array("from_document", "to_document")).alias("document_id"))
    nodes = get_or_create_nodes(nodes, ids)
    a, b = (nodes.select(F.col("id").alias(f"{x}_id"), F.col("document_id").alias(f"{x}_document")) for x in ("from", "to"))
    new = pairs.join(a, "from_document").join(b, "to_document").select("from_id", "to_id")
    return nodes, edges.unionByName(new)


def common_neighbors(log: DataFrame, a, b, as_of=None) -> DataFrame:
    both = active(log.where(F.col("src").isin(a, b)), as_of)
    return both.groupBy("dst").agg(F.count("*").alias("n")).where(F.col("n") == (1 if a == b else 2)).select("dst")


def collect_garbage(log: DataFrame, cutoff: int) -> DataFrame:
    """The last entries only, without tombstones older than cutoff; neighbours stay as they are."""
    return current(log).where(~(F.col("is_deleted") & (F.col("version") < cutoff)))


def reachable(edges: DataFrame, start: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(id, depth) of all that can be reached from start(id) along (src, dst), start included.

    One join a level, each level written to the checkpoint folder, until a level finds nothing new. With
    documents(id), ids without a document are neither given nor followed.
    """
    known = start.select("id").distinct() if documents is None else start.select("id").distinct().join(documents.select("id"), "id", "left_semi")
    level = checkpoint(known.withColumn("depth", F.lit(0)))
    seen, depth = level, 0
    while not level.isEmpty():
        depth += 1
        step = edges.join(level.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        if documents is not None:
            step = step.join(documents.select("id"), "id", "left_semi")
        level = checkpoint(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        seen = checkpoint(seen.unionByName(level))
    return seen


def dense_ids(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, id): ids from 0 in the order in which keys are first seen."""
    seen = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("__first"))
    return numbered(seen, "__first", key, name="id").select(key, "id")


def get_or_create_nodes(nodes: DataFrame, document_ids: DataFrame) -> DataFrame:
    """nodes(id, document_id) with a node for each document that has none."""
    new = document_ids.select("document_id").distinct().join(nodes, "document_id", "left_anti")
    start = nodes.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("m")).select("m").scalar()
    numbered = dense_ids(new, "document_id", "document_id").select((F.col("id") + start).cast("long").alias("id"), "document_id")
    return nodes.select("id", "document_id").unionByName(numbered)


def save_documents(documents: DataFrame, embeddings: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents(id, text) and embeddings(document_id, vector) with new(id, text, vector); a document
    without a vector adds none."""
    d = documents.unionByName(new.select("id", "text"))
    return d, embeddings.unionByName(new.where("vector is not null").select(F.col("id").alias("document_id"), "vector"))


def match_label(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes that MATCH (v:Label) RETURN v asks for, in order of their id."""
    m = re.fullmatch(r"\s*MATCH\s*\(\s*(\w+)\s*:\s*(\w+)\s*\)\s*RETURN\s+(\w+)\s*;?\s*", query, re.I)
    if not m or m[1] != m[3]:
        raise ValueError(f"unsupported query: {query}")
    return nodes.where(F.col("type") == m[2])


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """nodes(id, type, data) with new(type, data), whose ids follow on: an id is a position."""
    n = nodes.agg(F.count("*").alias("n")).select("n").scalar()
    number = numbered(new.select("type", "data", F.to_json("data").alias("__j")), "type", "__j", name="__n")
    return nodes.unionByName(number.select((F.col("__n") + n).cast("long").alias("id"), "type", "data"))


def add_relationships(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.unionByName(new.select(edges.columns))
