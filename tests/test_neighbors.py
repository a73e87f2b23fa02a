"""Nearest neighbours and threshold joins against brute force."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from test_catalog import DATA

from millrace.operators import neighbors, vectors

SCHEMA = "vec_id long, embedding array<float>, cell string, part string"


def clustered(n, seed=1, dim=12):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(9, dim))
    return [(i, [float(x) for x in (centres[i % 9] + 0.4 * rnd.normal(size=dim)).astype(np.float32)], "c", "c") for i in range(n)]


def cosines(rows):
    m = np.array([v if v is not None and any(v) else np.zeros(len(rows[0][1])) for _, v, *_ in rows], dtype=float)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    m = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    return m @ m.T


def test_recall(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", 50)
    rows = clustered(900)
    docs = spark.createDataFrame([*rows, (9001, None, "c", "c"), (9002, [0.0] * 12, "c", "c")], SCHEMA)
    neighbors.store(docs, str(tmp_path / "v"), 24)
    q = docs.where("vec_id % 20 = 0")
    exact = {(r.query_id, r.vec_id) for r in vectors.knn(docs.where("vec_id < 9000"), q, 5).collect()}
    got = neighbors.search(spark, str(tmp_path / "v"), q, 5, probes=8).collect()
    assert len(got) == 5 * 45 and len({(r.query_id, r.vec_id) for r in got} & exact) >= 0.9 * len(exact)
    every = neighbors.search(spark, str(tmp_path / "v"), q, 5, probes=24).collect()
    assert {(r.query_id, r.vec_id) for r in every} == exact
    c = cosines(rows)
    assert all(abs(r.similarity - c[r.query_id, r.vec_id]) < 1e-9 for r in got)


def test_recall_on_the_given_vectors(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    neighbors.store(e, str(tmp_path / "v"), 16)
    q = e.where("vec_id % 20 = 0")
    exact = {(r.query_id, r.vec_id) for r in vectors.knn(e, q, 5).collect()}
    got = {(r.query_id, r.vec_id) for r in neighbors.search(spark, str(tmp_path / "v"), q, 5, probes=12).collect()}
    assert len(got & exact) >= 0.9 * len(exact)


def test_tasks_hold_parts_of_cells_and_of_queries(spark, tmp_path, monkeypatch):
    """A row of the index is one vector, and cells of any size are cut, as are their queries."""
    monkeypatch.setattr(neighbors, "BLOCK", 50)
    monkeypatch.setattr(neighbors, "QUERIES", 20)
    docs = spark.createDataFrame(clustered(900), SCHEMA)
    neighbors.store(docs, str(tmp_path / "v"), 2)
    stored = spark.read.parquet(str(tmp_path / "v" / "vectors"))
    assert stored.count() == 900 and max(r["count"] for r in stored.groupBy("cell", "part").count().collect()) <= 100
    got = {(r.query_id, r.vec_id) for r in neighbors.search(spark, str(tmp_path / "v"), docs, 3, 2).collect()}
    assert got == {(r.query_id, r.vec_id) for r in vectors.knn(docs, docs, 3).collect()}


@pytest.mark.parametrize("least", [0.6, 0.9, 0.97])
def test_threshold_join(spark, monkeypatch, least):
    monkeypatch.setattr(neighbors, "BLOCK", 40)
    rows = clustered(260)
    rows += [(1000 + i, rows[3][1], "c", "c") for i in range(150)] + [(2000, None, "c", "c"), (2001, [0.0] * 12, "c", "c"), (2002, [0.0] * 12, "c", "c")]
    c = cosines(rows)
    want = {}
    for i, (k, v, *_) in enumerate(rows):
        direct = v is not None and any(v)
        same = min(j for j, w, *_ in rows if w == v) if direct else k
        want[k] = (same, int(((c[i] >= least) | (np.arange(len(rows)) == i)).sum()) - 1 if direct else 0)
    near = np.abs(c - least).min()
    assert near > 1e-9
    got = {r.vec_id: (r.same_as, r.n_links) for r in neighbors.links_above(spark.createDataFrame(rows, SCHEMA).repartition(4), least).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert got == {k: (s, n if k not in range(1000, 1150) and s != 3 else n) for k, (s, n) in want.items()}


def test_pairs_are_counted_where_they_are_found(spark, monkeypatch):
    """Groups of bounded size meet, and a tile hands on sums: no pair leaves it, however many there are."""
    monkeypatch.setattr(neighbors, "BLOCK", 40)
    docs = spark.createDataFrame([(i, [1.0, 0.001 * i]) for i in range(300)], "id long, v array<float>").selectExpr("id", "1L as n", "v")
    tiles = neighbors._tiled(docs, 0.9)
    sizes = [r["count"] for r in tiles.groupBy("tile", "side").count().collect()]
    assert max(sizes) <= 80 and sum(sizes) < 300 * 20
    assert sorted(map(tuple, neighbors._linked(docs, 0.9).collect())) == [(i, 299) for i in range(300)]


def test_shells_far_apart_do_not_meet(spark):
    """Two opposite clusters: blocks of the one never meet blocks of the other."""
    rnd = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.r_[1 if i % 2 else -1, 0.01 * rnd.normal(size=5)]]) for i in range(60)]
    met = neighbors.pairs_above(spark.createDataFrame(rows, "id long, v array<float>"), 0.95)
    assert met.count() == 2 * 30 * 29 // 2
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    neighbors.store(none, str(tmp_path / "v"), 4)
    assert neighbors.search(spark, str(tmp_path / "v"), none, 3, 2).count() == 0
    assert neighbors.links_above(none, 0.5).count() == 0


def tile(left, right, dim, seed=2, alike=False):
    """Arrow batches of 10,000 rows, as Spark hands them to a task: one tile of left and right rows."""
    v = np.random.default_rng(seed).normal(size=(left + right, dim)).astype(np.float32)
    v[:] = v[0] if alike else v
    side, n = np.repeat([0, 1], [left, right]).astype(np.int32), np.ones(left + right, dtype=np.int64)
    ids = np.r_[np.arange(left) * 3, np.arange(right)]
    whole = pa.RecordBatch.from_arrays([pa.array(n), pa.array(side), pa.array(ids), pa.array(n), pa.ListArray.from_arrays(np.arange(0, v.size + 1, dim, dtype=np.int32), v.reshape(-1))], ["tile", "side", "id", "n", "v"])
    return [whole.slice(at, 10_000) for at in range(0, left + right, 10_000)], v[:left].astype(float), v[left:].astype(float), ids[:left]


def peak(f):
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_batch_passes_in_slices():
    """A batch of 10,000 vectors of 512 numbers would be 41 MB of double precision, and as much again for unit vectors."""
    batches, *_ = tile(300, 9_700, 512)
    assert peak(lambda: [None for _ in neighbors._meetings(batches)]) < 12
    assert sum(len(right[0]) for *_, right in neighbors._meetings(batches)) == 9_700


@pytest.mark.parametrize("alike", [False, True])
def test_memory_of_a_search_task(alike):
    """What a slice and 4,096 queries may give is k rows a query, also at the start and where all vectors are equal."""
    batches, q, x, ids = tile(4096, 2000, 16, alike=alike)
    found = []
    assert peak(lambda: found.extend(neighbors._nearest(batches, 5))) < 64
    got = {}
    for a, b, s in zip(*map(np.concatenate, zip(*found))):
        got.setdefault(int(a), []).append((int(b), s))
    some = range(0, 4096, 37)
    for i in some:
        c = (x @ q[i]) / np.linalg.norm(x, axis=1) / np.linalg.norm(q[i])
        want = [int(j) for j in np.lexsort((np.arange(len(x)), -c.round(12))) if j != ids[i]][:5]
        assert [j for j, _ in got[int(ids[i])]] == want
        assert np.allclose([s for _, s in got[int(ids[i])]], c[want])


def test_centres_take_no_python_worker(spark, tmp_path, monkeypatch):
    def no(*_, **__):
        raise AssertionError("rows are pickled")

    monkeypatch.setattr(spark.sparkContext, "parallelize", no)
    docs = spark.range(60).selectExpr("id as vec_id", "array(cast(id % 3 as float), 1f) as embedding")
    neighbors.store(docs, str(tmp_path / "v"), 3)
    assert spark.read.parquet(str(tmp_path / "v" / "cells")).count() == 3
