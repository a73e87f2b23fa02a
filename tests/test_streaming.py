import json

from pyspark.sql import functions as F

from millrace.streaming import turns


def event(text, reason=None):
    return "data: " + json.dumps({"choices": [{"finish_reason": reason, "delta": {"content": text}}]})


def test_turns_over_batches(spark, tmp_path):
    schema, source = "turn_id string, seq long, line string", tmp_path / "in"
    source.mkdir()
    batches = [[("a", 0, event("Hel")), ("b", 0, event("x"))], [("a", 1, event("lo")), ("a", 2, event("", "stop")), ("b", 1, "data: {broken")], [("a", 3, event("late")), ("c", 0, "data: [DONE]")]]
    out = str(tmp_path / "out")
    for i, rows in enumerate(batches):  # one run a batch, as a restarted query would have it
        (source / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("turn_id", "seq", "line"), r))) for r in rows))
        ended = turns.accumulate(spark.readStream.schema(schema).json(str(source)), silent_ms=None)
        q = ended.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(90)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("a", "Hello", "complete"), ("b", "x", "error"), ("c", "", "complete")]


def test_saved_turns(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "0.json").write_text(json.dumps({"turn_id": "a", "text": "two words two", "status": "complete"}))
    stream = spark.readStream.schema(turns.OUT).json(str(source))
    q = turns.save_turns(stream, str(tmp_path / "db"), str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert spark.read.parquet(str(tmp_path / "db/chats")).count() == 1
    assert spark.read.parquet(str(tmp_path / "db/postings")).agg(F.sum("f")).first()[0] == 3
