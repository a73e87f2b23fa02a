"""Streamed chats: restarts, timers, joins of streams and the three stores."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F
from test_streaming import event

from millrace.functions import vector as V
from millrace.operators import chat, index, search
from millrace.sources import files
from millrace.streaming import chats, turns

LINES = "turn_id string, seq long, line string"


def put(folder, name, rows, schema):
    folder.mkdir(exist_ok=True)
    cols = [c.split()[0] for c in schema.split(", ")]
    (folder / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(cols, r))) for r in rows))


def once(writer):
    q = writer.trigger(availableNow=True).start()
    assert q.awaitTermination(120)


def awhile(writer, until=None):
    """Timers of processing time keep a query running: it is stopped when its files are read (or ``until`` holds),
    as one that is restarted later."""
    q = writer.start()
    try:
        for _ in range(120):
            if until() if until else any(p.numInputRows for p in q.recentProgress):
                return
            assert q.isActive, q.exception()
            time.sleep(0.5)
        raise TimeoutError
    finally:
        q.stop()


def test_turns_end_once_over_restarts(spark, tmp_path):
    batches = [
        [("a", 0, event("Hel")), ("b", 0, event("x")), ("n", 0, ": comment"), (None, 0, event("y"))],
        [("a", 1, event("lo")), ("a", 2, event("", "stop")), ("b", 1, "data: {broken"), ("d", 0, event("cut", "filter"))],
        [("a", 3, event("late")), ("c", 0, "data: [DONE]"), ("e", 0, event("open"))],
    ]
    out, src = str(tmp_path / "out"), tmp_path / "in"
    for i, rows in enumerate(batches):  # a restarted query for each batch
        put(src, i, rows, LINES)
        s = chats.ended(spark.readStream.schema(LINES).json(str(src)))
        awhile(s.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("a", "Hello", "complete"), ("b", "x", "error"), ("c", "", "complete"), ("d", "cut", "error")]


def test_a_silent_turn_times_out(spark, tmp_path):
    out, src = str(tmp_path / "out"), tmp_path / "in"
    put(src, 0, [("a", 0, event("half"))], LINES)
    got = lambda: sorted(map(tuple, spark.read.schema(turns.OUT).parquet(out).collect())) if (tmp_path / "out" / "_spark_metadata").exists() else []
    go = lambda until: awhile(chats.ended(spark.readStream.schema(LINES).json(str(src)), silent_ms=50).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")), until)
    go(got)
    put(src, 1, [("b", 0, event("x", "stop")), ("a", 1, event("too late", "stop"))], LINES)
    go(lambda: len(got()) > 1)
    assert got() == [("a", "half", "timeout"), ("b", "x", "complete")]


P, R = "turn_id string, sent timestamp, prompt string", "turn_id string, ended timestamp, response string"


def test_streams_meet_within_the_watermark(spark, tmp_path):
    p, r = tmp_path / "p", tmp_path / "r"
    put(p, 0, [("a", "2024-01-01T00:00:00Z", "pa"), ("b", "2024-01-01T00:01:00Z", "pb"), ("x", "2024-01-01T00:00:00Z", "px"), (None, "2024-01-01T00:00:00Z", "null")], P)
    put(r, 0, [("a", "2024-01-01T00:02:00Z", "ra"), ("y", "2024-01-01T00:02:00Z", "ry"), ("x", "2024-01-01T00:20:00Z", "over ten minutes later")], R)
    out = str(tmp_path / "out")
    read = lambda path, schema: spark.readStream.schema(schema).json(str(path))
    go = lambda: once(chats.paired(read(p, P), read(r, R)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")))
    go()
    put(r, 1, [("b", "2024-01-01T00:05:00Z", "rb")], R)  # within the watermark: 20 - 5 minutes of the slower stream
    go()
    put(p, 1, [("z", "2024-01-02T00:00:00Z", "pz")], P)
    put(r, 2, [("z", "2024-01-02T00:00:01Z", "rz")], R)
    go()
    put(p, 2, [("late", "2024-01-01T00:00:00Z", "older than the watermark")], P)
    put(r, 3, [("late", "2024-01-01T00:00:01Z", "older than the watermark")], R)
    go()
    assert sorted((x.turn_id, x.prompt, x.response) for x in spark.read.parquet(out).collect()) == [("a", "pa", "ra"), ("b", "pb", "rb"), ("z", "pz", "rz")]


TURN = "id string, prompt string, response string, model_name string, ended timestamp"


def test_three_stores_hold_each_turn_once(spark, tmp_path):
    def fake(texts):
        return [[float(len(t)), 1.0, 2.0] for t in texts]

    src, base = tmp_path / "in", str(tmp_path / "db")
    rows = [(f"t{i}", f"prompt {i} the", f"answer w{i % 3}", "assistant", f"2024-01-0{1 + i % 9}T00:00:00Z") for i in range(12)]
    writer = lambda: chats.save(spark.readStream.schema(TURN).json(str(src)), base, str(tmp_path / "c"), fake, 3)
    put(src, 0, rows[:7], TURN)
    once(writer())
    put(src, 1, rows[7:], TURN)
    # A batch whose stores are written, but which is lost before it is committed, runs again.
    from millrace.streaming.chats import index as used

    real = used.append

    def lost(*a):
        real(*a)
        raise RuntimeError("lost")

    used.append = lost
    q = writer().trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        q.awaitTermination(120)
    used.append = real
    once(writer())
    saved = spark.createDataFrame([(i, p, r, m) for i, p, r, m, _ in rows], "id string, prompt string, response string, model_name string")
    want, entries = chat.saved(saved.join(spark.createDataFrame([(t[0], t[4]) for t in rows], "id string, e string"), "id"), F.to_timestamp("e"))
    got = spark.read.parquet(f"{base}/chats")
    assert sorted(r.id for r in got.collect()) == sorted(t[0] for t in rows)
    vectors = {r.id: r.v for r in got.select("id", V.from_blob("embedding").alias("v")).collect()}
    assert vectors == {r.id: [float(len(r.embedded_text)), 1.0, 2.0] for r in want.collect()}
    assert sorted((r.id, r.body) for r in spark.read.parquet(f"{base}/entries").collect()) == sorted((r.id, r.body) for r in entries.collect())
    ix = index.Index(spark, f"{base}/search")
    key = lambda df: sorted((r.row_id, round(r.score, 6)) for r in df.collect())
    assert ix.statistics().first().n == 12
    assert key(ix.scored(["the", "w1"])) == key(search.bm25(saved, "id", chats.WEIGHTS, ["the", "w1"]))


def test_embedder_in_flight_with_attempts(spark):
    """Three requests at a time, each failing twice: no row is lost and order is kept."""
    df = spark.createDataFrame([(i, f"text {i}") for i in range(95)], "id long, text string").coalesce(1)

    def embed(texts):
        seen, state, lock = vars(threading).setdefault("_embedder", ({}, {"now": 0, "most": 0}, threading.Lock()))  # of the worker
        with lock:
            n = seen[texts[0]] = seen.get(texts[0], 0) + 1
            state["now"] += 1
            state["most"] = max(state["most"], state["now"])
        time.sleep(0.05)
        with lock:
            state["now"] -= 1
            assert state["most"] <= 3
        if n < 3 and texts[0] in ("text 0", "text 20"):
            raise OSError("busy")
        return [[float(t.split()[1]), float(state["most"])] + [0.0] * 766 for t in texts]

    got = files.embedded(df, "text", embed).collect()
    assert [(r.id, r.vector[0]) for r in got] == [(i, float(i)) for i in range(95)]
    assert max(r.vector[1] for r in got) == 3.0
    for bad in (lambda t: [[0.0]] * len(t), lambda t: [[0.0] * 768]):
        with pytest.raises(Exception, match="dimensions"):
            files.embedded(df, "text", bad).collect()
