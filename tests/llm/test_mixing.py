import random
import re
from collections import Counter

import pytest

from millrace.llm import mixing


def levels(sizes):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(sizes)
    while free:
        left = total - sum(out.values())
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 2 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / w for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            free.discard(s)
    return out


def sample():
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice(["a", "bé", "c"]) + rnd.choice([" ", "\n\t"]) for _ in range(n))
    rows = [(i, text(rnd.choice([0, 1, 50, 700])), rnd.choice(["s1", "s2", "s10", "ß", "Z", None, ""])) for i in range(150)]
    return [*rows, (500, None, "s1"), (501, "", "only empty"), (502, "one", "tiny"), (503, text(40_000), "hot"), (504, text(300), "s2"), (504, rows[-1][1], "s2"), (505, "x y", "s2"), (505, "x y", "s2"), (None, "no id here", "s1")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, source string, block string, size int")


def test_targets_and_limits(spark):
    rows = sample()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = mixing.taken(frame(spark, rows)).collect()
    by = Counter()
    for _, t, s in rows:
        by[s] += size(t)
    want = levels(by)
    assert sorted(((r.doc_id, r.size) for r in got), key=str) == sorted(((d, size(t)) for d, t, _ in rows), key=str)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert Counter((r.source_size, round(r.target, 6)) for r in got) == Counter((by[s], round(want[s], 6)) for _, _, s in rows)
    groups = Counter()
    for r in got:
        groups[r.source_size, round(r.target, 6)] += r.taken
    for (n, target), taken in groups.items():
        alike = [s for s in by if (by[s], round(want[s], 6)) == (n, target)]
        assert abs(taken - len(alike) * target) <= 0.5 * len(alike)
    again = mixing.taken(frame(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_holds_the_words(spark):
    rows = sample()
    docs = frame(spark, rows)
    blocks = mixing.mix(docs).collect()
    assert sorted(b.slot for b in blocks) == list(range(len(blocks)))
    assert all(len(b.text.split(" ")) == b.n_words <= mixing.BLOCK for b in blocks)
    assert sum(b.n_words for b in blocks) == sum(r.taken for r in mixing.taken(docs).collect())
    have = {}
    for d, t, s in rows:
        have.setdefault(s, Counter()).update(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for s, words in have.items():
        used = Counter(w for b in blocks if b.source == s for w in b.text.split(" "))
        assert all(used[w] <= 2 * words[w] for w in used)


def test_permutation_is_a_bijection(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        df = spark.range(n).select(F.col("id").alias("x"), mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3).cast("long")).alias("y"))
        df = df.withColumn("z", mixing._permuted(F.col("y"), F.lit(n).cast("long"), F.lit(3).cast("long"), back=True))
        got = df.collect()
        assert sorted(r.y for r in got) == list(range(n)) and all(r.x == r.z for r in got)


def test_draws_beyond_quotas_are_dealt_on(spark):
    """Many sources of a few slots each, in small shards: every quota is met to the slot."""
    rows = [(i, "w " * (130 * (1 + i % 5)), f"s{i:03}") for i in range(60)]
    sources, _ = mixing.lay_out(frame(spark, rows), ["doc_id"])
    quota = mixing.checkpoint(mixing.quotas(sources))
    want = {r.src: r.n_slots for r in quota.collect()}
    got = mixing.slots(quota, shard=16).collect()
    assert Counter(r.src for r in got) == Counter(want)
    assert sorted(r.slot for r in got) == list(range(sum(want.values())))
    assert max(Counter((r.src, r.block) for r in got).values()) <= 2


@pytest.mark.parametrize("rows", [[], [(1, None, None), (2, " ", "a")]])
def test_without_words(spark, rows):
    got = mixing.taken(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.size, r.taken, r.target) for r in got) == [(d, 0, 0, 0.0) for d, _, _ in rows]
    assert mixing.mix(frame(spark, rows)).count() == 0
