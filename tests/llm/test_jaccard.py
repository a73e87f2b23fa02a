import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import jaccard

SCHEMA = "doc_id long, text string, sid string, size string, token string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def edited(rnd, words, edits, vocab):
    w = list(words)
    for _ in range(edits):
        w[rnd.randrange(len(w))] = rnd.choice(vocab)
    return " ".join(w)


def sample(seed, groups, copies, lengths, passage=0):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)] + ["Ünï", "É"]
    shared, rows = [rnd.choice(vocab) for _ in range(passage)], []
    for _ in range(groups):
        base = [rnd.choice(vocab) for _ in range(rnd.choice(lengths))] + shared
        for _ in range(rnd.choice(copies)):
            rows.append((len(rows) * 37 % 1009, edited(rnd, base, rnd.choice([0, 0, 1, 1, 2, 3, 5]), vocab)))
    rnd.shuffle(rows)
    return rows


def run(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(5)
    return sorted(map(tuple, jaccard.classes(docs, **how).collect()), key=str)


ODD = [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5003, "one"), (None, "ONE"), (None, "no id here"), (5004, "a b"), (5005, "a B"), (5006, "x y " * 30_000), (5007, "y x " * 30_000), (None, None)]


def test_against_brute_force(spark):
    rows = sample(1, 25, [1, 2, 9, 30], [1, 2, 5, 30, 60, 200], passage=20) + ODD
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("rounds", [3, 1])
def test_hot_lists_lose_no_link(spark, monkeypatch, rounds):
    """Large groups of near copies, of which some link only by way of others, in lists cut into blocks and salted."""
    monkeypatch.setattr(jaccard, "SALT", 8)
    rows = sample(2, 2, [150], [60, 150])
    default = jaccard.set_classes
    monkeypatch.setattr(jaccard, "crossing", lambda e, b, p, f=jaccard.crossing: f(e, b, p, 2))
    monkeypatch.setattr(jaccard, "set_classes", lambda *a: default(*a, rounds=rounds))
    want = brute(rows)
    assert 2 < len({c for *_, c in want}) < 250
    assert run(spark, rows) == want


def test_other_thresholds(spark):
    rows = sample(3, 12, [1, 8], [10, 40], passage=10)
    assert run(spark, rows, percent=60) == brute(rows, 60)


def test_small(spark):
    assert run(spark, []) == []
    assert run(spark, ODD[:3]) == brute(ODD[:3])
    assert run(spark, [(2, "same text it is"), (1, "same text it is")]) == [(1, 2, 1), (2, 2, 1)]


def test_pairs_of_a_class_are_not_made(spark):
    """A list's largest class never meets itself."""
    rows = [(f"t{t}", i, 100, 0, 0 if i < 900 else i) for t in range(3) for i in range(903)]
    e = spark.createDataFrame(rows, "token string, sid long, size long, pos int, class long")
    bits = spark.createDataFrame([(i, 0, 0, 0, 0) for i in range(903)], "sid long, b0 long, b1 long, b2 long, b3 long")
    got = jaccard.crossing(e, bits, 90).agg(F.count("*")).first()[0]
    assert got == 3 * 900 + 3


def test_wide_bitmaps_never_exceed_the_difference():
    rnd = random.Random(8)
    for _ in range(100):
        x = {rnd.getrandbits(64) for _ in range(rnd.randrange(513, 6000))}
        y = set(rnd.sample(sorted(x), rnd.randrange(513, len(x) + 1))) | {rnd.getrandbits(64) for _ in range(rnd.randrange(1500))}
        wide = [jaccard.wide_bitmap(np.array(sorted(s), dtype=np.uint64)) for s in (x, y)]
        differ = jaccard.wide_apart(*wide)
        assert differ <= len(x ^ y) and (differ - len(x ^ y)) % 2 == 0
    assert jaccard.wide_bitmap(np.arange(jaccard.WIDE, dtype=np.uint64)) is None
    assert jaccard.wide_apart(wide[0], wide[0]) == 0


def test_large_sets_at_the_bound(spark):
    """Copies of long texts with about as many edits as a link allows, and long texts that share a passage."""
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for n in (505, 520, 800, 1100, 2100):
        base = [rnd.choice(vocab) for _ in range(n)]
        rows += [(len(rows) + i, edited(rnd, base, n * share // 1000, vocab)) for i, share in enumerate((0, 14, 17, 18, 20, 25))]
    passage = [rnd.choice(vocab) for _ in range(900)]
    rows += [(len(rows) + i, " ".join(passage + [rnd.choice(vocab) for _ in range(400)])) for i in range(6)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert 1 < len({r[2] for r in got[:30]}) < len(rows)
