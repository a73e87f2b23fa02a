import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

from pyspark.sql import functions as F

from millrace.llm import importance

SCHEMA = "doc_id long, text string, rid string, n string, bucket string"


def feats(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(rows, target):
    fs = [feats(t) for _, t in rows]
    s, t = Counter(b for _, f in fs for b in f), Counter(b for x in target for b in feats(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out = []
    for (i, _), (n, f) in zip(rows, fs):
        w = sum(map(gain, f)) // len(f) if f else 0
        h = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for k, x in enumerate(able[: 25 * len(able) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


def sample():
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(200)] + ["Ünï", "É", "don't", "x_y", "9"]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 5, 19, 20, 40, 300])))) for i in range(120)]
    return [*rows, (500, None), (501, " .,\n"), (502, "one"), (503, "Same words " * 15), (503, "Same words " * 15), (None, "no id at all " * 9), (None, None), (600, "x y " * 40_000)]


def run(spark, rows, target):
    docs = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(5)
    bench = spark.createDataFrame([(1, t) for t in target], "item_id long, text string")
    return sorted(map(tuple, importance.resample(docs, bench).collect()), key=str)


def test_against_brute_force(spark):
    target = ["w1 w2 w3 w4 " * 9, None, "É w7"]
    want = brute(sample(), target)
    assert run(spark, sample(), target) == want
    assert sum(r[4] is not None for r in want) > 10


def test_empty_tables(spark):
    assert run(spark, [], ["a"]) == []
    assert run(spark, sample(), []) == brute(sample(), [])
    assert run(spark, [(1, None)], [None]) == brute([(1, None)], [None])


def test_documents_are_shuffled_once(spark):
    """What a scan gives is dealt by row once; windows, features and sums need no shuffle of their own."""
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    plan = importance.features(docs).groupBy("rid", "doc_id").agg(F.count("bucket"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan
