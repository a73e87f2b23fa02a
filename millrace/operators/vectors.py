"""Vector search: brute-force cosine top-k and thresholds, nearest neighbours in blocks, reranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import vector as V

#: Query vectors sent to the executors at once, and the bytes they may have.
BLOCK_ROWS, BLOCK_BYTES = 4096, 32 << 20
#: Rows that a block meets at a time: 8 MB of similarities.
SLICE = 256


def similarities(corpus: DataFrame, query, vec: str = "embedding", lenient: bool = False) -> DataFrame:
    """corpus with similarity to one query vector: a list, or a column such as a scalar subquery."""
    if not isinstance(query, Column):
        return corpus.withColumn("similarity", V.cosine(vec, V.literal(query), lenient))
    held = corpus.withColumn("__query", query)  # a subquery can't stand in a lambda
    return held.withColumn("similarity", V.cosine(vec, F.col("__query"), lenient)).drop("__query")


def top_k(corpus: DataFrame, query, k: int, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    return similarities(corpus, query, vec).orderBy(F.col("similarity").desc(), key).limit(k)


def above(corpus: DataFrame, query, least: float, strict: bool = False, vec: str = "embedding") -> DataFrame:
    """Rows whose (lenient) similarity is at least ``least``; strict: greater."""
    s = similarities(corpus, query, vec, lenient=True)
    return s.where(F.col("similarity") > least if strict else F.col("similarity") >= least)


def blocks(queries: DataFrame, key: str, vec: str):
    """(ids, matrix of unit rows), as many as fit a block, one block after the other."""
    ids, rows = [], []
    for r in queries.select(key, vec).where(F.col(vec).isNotNull()).toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) >= BLOCK_ROWS or len(ids) * len(r[1]) * 8 >= BLOCK_BYTES:
            yield ids, _unit(np.array(rows, dtype=float))
            ids, rows = [], []
    if ids:
        yield ids, _unit(np.array(rows, dtype=float))


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def knn(corpus: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, <key>, similarity, rank): the k nearest rows of every query, itself left out.

    Queries go out in blocks of bounded size, each of which all rows meet in one matrix product per
    Arrow batch; a task keeps k candidates a query, and the last word is had by query.
    """
    out = None
    for ids, m in blocks(queries, key, vec):
        sent = corpus.sparkSession.sparkContext.broadcast((ids, m))

        def run(batches, sent=sent):
            ids, m = sent.value
            names = np.array(ids, dtype=np.int64)
            best_s, best_i = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), dtype=np.int64)
            for b in batches:
                for at in range(0, b.num_rows, SLICE):
                    part = b.slice(at, SLICE)
                    flat, own = part.column(1).flatten().to_numpy(zero_copy_only=False), part.column(0).to_numpy(zero_copy_only=False)
                    s = m @ _unit(flat.astype(float).reshape(len(own), -1)).T
                    s[own[None, :] == names[:, None]] = -np.inf
                    if best_s.shape[1] == k:  # queries to which no row is nearer than the last one kept are done
                        todo = np.flatnonzero(s.max(axis=1) >= best_s[:, -1])
                    else:
                        todo = np.arange(len(ids))
                        best_s = np.pad(best_s, ((0, 0), (0, k - best_s.shape[1])), constant_values=-np.inf)
                        best_i = np.pad(best_i, ((0, 0), (0, k - best_i.shape[1])))
                    s, i = np.concatenate([best_s[todo], s[todo]], axis=1), np.concatenate([best_i[todo], np.broadcast_to(own, (len(todo), len(own)))], axis=1)
                    order = np.lexsort((i, -s), axis=1)[:, :k]
                    best_s[todo], best_i[todo] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            real = best_s > -np.inf
            q = np.repeat(names, real.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best_i[real]), pa.array(best_s[real])], ["query_id", key, "similarity"])

        part = corpus.select(F.col(key).cast("long"), vec).where(F.col(vec).isNotNull()).mapInArrow(run, f"query_id long, {key} long, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return corpus.select(F.col(key).cast("long").alias("query_id"), F.col(key).cast("long"), F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).limit(0)
    by = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), key)
    return out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def lookup(hits: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hits with their documents; hits without one go, repeated hits stay."""
    return hits.join(docs, key)


def rerank(hits: DataFrame, vectors: DataFrame, query, least: float = 0.5, key: str = "doc_id", order: str = "rank") -> DataFrame:
    """Lexical hits in their order with what their fields hold above ``least``: hits(key, rank), vectors
    (key, field, body, embedding). A hit whose fields all miss says so."""
    s = similarities(vectors, query)
    found = hits.join(s, key, "left")
    body = F.when(F.col("similarity") > least, F.col("body"))
    joined = found.groupBy(key, order).agg(F.array_sort(F.collect_list(F.when(body.isNotNull(), F.struct("field", body.alias("b"))))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["b"]), "")
    return joined.select(key, order, F.when(text != "", F.concat(text, F.lit("\n"))).otherwise("No relevant content found.\n").alias("content"))


def rerank_batch(hits: DataFrame, fields: DataFrame, prompts: DataFrame, least: dict[str, float], key: str = "doc_id") -> DataFrame:
    """Lexical hits of many prompts, in their order, with what their fields hold for their prompt: hits(prompt_id, key,
    rank), fields(key, field, body, embedding), prompts(prompt_id, embedding), the cut above which a field's
    similarity must be. (prompt_id, key, rank, content): bodies in order of the cuts, or the word that there are none.

    Hits meet fields by key and prompts by id, so that a similarity is computed for a hit's fields only.
    Hits without a document or without a prompt go; a hit all of whose vectors are null or zero finds nothing.
    """
    order = F.element_at(F.create_map(*(F.lit(x) for i, f in enumerate(least) for x in (f, i))), F.col("field"))
    cut = F.element_at(F.create_map(*(F.lit(x) for f, v in least.items() for x in (f, float(v)))), F.col("field"))
    known = fields.where(F.col("field").isin(list(least))).select(key, "field", "body", F.col("embedding").alias("__v"))
    met = hits.select("prompt_id", key, "rank").join(known, key).join(prompts.select("prompt_id", F.col("embedding").alias("__p")), "prompt_id")
    kept = F.when(V.cosine("__v", "__p", lenient=True) > cut, F.struct(order.alias("at"), "body"))
    parts = met.groupBy("prompt_id", key, "rank").agg(F.array_sort(F.collect_list(kept)).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["body"]), "")
    return parts.select("prompt_id", key, "rank", F.when(F.size("parts") > 0, F.concat(text, F.lit("\n"))).otherwise("No relevant content found.\n").alias("content"))


def rank_labels(labels="labels", scores="scores"):
    """Labels by falling score, ties in their order; an error if the arrays differ in size."""
    pairs = F.transform(F.arrays_zip(F.col(labels).alias("l"), F.col(scores).alias("s")), lambda x, i: F.struct((-x["s"]).alias("n"), i.alias("i"), x["l"].alias("label")))
    ranked = F.transform(F.array_sort(pairs), lambda x: x["label"])
    return F.when(F.size(labels) == F.size(scores), ranked).otherwise(F.raise_error(F.lit("labels and scores differ in number")).cast("array<string>"))


def classify(df: DataFrame, text: str, labels: list[str], scorer) -> DataFrame:
    """df with ranked: labels by falling score. scorer(text column, label) -> score column: a model of the
    caller's (as a pandas UDF) or an expression."""
    t = df.select("*", F.array(*(F.lit(x) for x in labels)).alias("__l"), F.array(*(scorer(F.col(text), x).cast("double") for x in labels)).alias("__s"))
    return t.select(*df.columns, rank_labels("__l", "__s").alias("ranked"))
