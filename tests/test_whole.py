"""Queries over whole tables: no row is left out."""

import hashlib

import pyarrow.parquet as pq
from pyspark.sql import functions as F
from test_catalog import DATA

from millrace.plans import catalog


def column(name, col):
    return pq.read_table(f"{DATA}/{name}.parquet", columns=[col]).column(0).to_pylist()


def test_whole_tables(spark):
    run = lambda name: catalog.queries()[name](spark, DATA)
    assert {r.vec_id for r in run("l2_normalize").select("vec_id").distinct().collect()} == set(column("embeddings", "vec_id"))
    assert run("sync_tables").count() == sum(k % 3 != 0 for k in column("part", "p_partkey"))
    assert set(column("documents", "doc_id")) <= {r.document_id for r in run("graph_nodes").collect()}
    assert {r.src for r in run("edge_updates").select("src").distinct().collect()} == set(column("lineitem", "l_suppkey"))


def test_whole_jobs(spark):
    run = lambda name: catalog.queries()[name](spark, DATA)
    assert run("model_paths").count() == len(column("events", "event_id"))
    texts = dict(zip(column("documents", "doc_id"), column("documents", "text")))
    got = run("retrieve").collect()
    assert len(got) == 10 and all(r.text == texts[r.doc_id] for r in got) and any(len(r.text) > 200 for r in got)


def test_links_follow_the_row_count(spark, tmp_path):
    n = 1000
    spark.range(n).select(F.col("id").alias("doc_id")).write.parquet(f"{tmp_path}/documents.parquet")
    seen, todo = {0}, [0]
    while todo:
        x = todo.pop()
        new = {y for y in ((x * 7 + 3) % n, (x + 11) % n) if y % 13} - seen
        seen |= new
        todo += new
    assert len(seen) > 400
    assert sorted(r.id for r in catalog.queries()["bfs_connected"](spark, str(tmp_path)).collect()) == sorted(seen)


def test_index_chunks(spark):
    docs = catalog._metadata(catalog.table(spark, DATA, "documents")).select("page_content", "metadata.source").collect()
    want = []
    for text, source in docs:
        b = (text or "").encode()
        key = source if source is not None else hashlib.sha1(b).hexdigest()
        want += [(f"{key}-{i // 2048}", b[i : i + 2048].decode(errors="replace")) for i in range(0, len(b), 2048)]
    assert any(not k.endswith("-0") for k, _ in want)
    assert sorted(map(tuple, catalog.queries()["index_chunks"](spark, DATA).collect())) == sorted(want)
