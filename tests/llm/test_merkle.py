import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, at string, n string, lefts long"
OUT = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*xs):
    return sha256("".join(xs).encode()).hexdigest()


def digest(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes, fanout):
    """Root and, for each node, its (left, right) siblings by level."""
    paths, at, now = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(now) > 1:
        for i, q in enumerate(at):
            lo = q // fanout * fanout
            paths[i].append((now[lo:q], now[q + 1 : lo + fanout]))
            at[i] = q // fanout
        now = [h(*now[j : j + fanout]) for j in range(0, len(now), fanout)]
    return now[0], paths


def brute(rows, fanout=2):
    """rows: (doc_id, text, lang, source, n_chars)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    out, subroots, held = [], [], []
    for lang in langs:
        own = sorted(((r[0] is not None, r[0] or 0, digest(r[0], r[3], r[2], r[4], r[1]), i) for i, r in enumerate(rows) if r[2] == lang))
        root, paths = climb([x[2] for x in own], fanout)
        subroots.append(root)
        held.append([(rows[x[3]], x[2], root, p) for x, p in zip(own, paths)])
    if not rows:
        return []
    root, tops = climb(subroots, fanout)
    for group, top in zip(held, tops):
        for (doc_id, text, lang, source, n), own, subroot, path in group:
            path = path + top
            now = digest(doc_id, source, lang, n + 1, text) if doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 else own
            for left, right in path:
                now = h(*left, now, *right)
            out.append((doc_id, own, subroot, root, h(*(x for a, b in path for x in a + b)), now, now == root))
    return sorted(out, key=str)


def sample(n, seed=5):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        t = rnd.choice([None, "", "Ünï ", "word\n" * rnd.randint(1, 9), "x" * 50_000 if i == 3 else "y"])
        rows.append((i * 7 % n if rnd.random() < 0.9 else rnd.choice([None, 1, 2]), t, rnd.choice(["en", "en", "en", "de", None, "", "é"]), rnd.choice([None, "s"]), rnd.choice([None, 0, len(t or "")])))
    return rows + rows[:5] + [(77, "alone", "xx", None, 5)]


def got(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "c", "c", 1) for r in rows], SCHEMA).repartition(5)
    return sorted(map(tuple, merkle.verified(merkle.manifest(docs, **how)).select(OUT).collect()), key=str)


@pytest.mark.parametrize(("fanout", "levels"), [(2, 10), (2, 2), (3, 1), (2, 3)])
def test_against_brute_force(spark, fanout, levels):
    rows = sample(130)
    want = brute(rows, fanout)
    assert got(spark, rows, fanout=fanout, levels=levels) == want
    bad = [r for r in want if not r[-1]]
    assert bad and all(zlib.crc32(str(r[0]).encode()) % 7 == 0 for r in bad)


def test_small(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, "a", "en", None, 1)]) == brute([(1, "a", "en", None, 1)])
    one = got(spark, [(1, "a", "en", None, 1)])[0]
    assert one[1] == one[2] == one[3] and one[4] == h()
    equal = [(7, "same", "en", "s", 4)] * 9
    assert got(spark, equal, levels=1) == brute(equal)


def test_a_bucket_never_holds_more_than_its_rows(spark):
    """One language of all rows: the groups of every round are bounded."""
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(1).alias("n_chars"))
    rows = merkle.manifest(docs, levels=4)
    assert rows.select("root").distinct().count() == 1
    assert rows.select(F.size("lefts").alias("n")).distinct().collect()[0].n == 13
    assert merkle.verified(rows).where("verified").count() == sum(zlib.crc32(str(i).encode()) % 7 != 0 for i in range(5000))
