import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import kneserney as kn

SCHEMA = "doc_id long, text string, lang string, n string"


def grams(t):
    x = b" " * 4 + kn.normal((t or "").encode())
    return [x[i : i + 5] for i in range(len(x) - 4)]


def reference(texts):
    """The recursion of interpolated modified Kneser-Ney, one probability at a time."""
    tables = {5: Counter(g for t in texts for g in grams(t))}
    for k in range(4, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    offs, ctx = {}, {}
    for k, t in tables.items():
        offs[k] = kn.discounts(Counter(c for c in t.values() if c <= 4))
        total, lost = Counter(), defaultdict(float)
        for g, c in t.items():
            total[g[:-1]] += c
            lost[g[:-1]] += offs[k][min(c, 3) - 1]
        ctx[k] = {h: (n, lost[h] / n) for h, n in total.items()}

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        if g[:-1] not in ctx[k]:
            return p(g[1:])
        total, gamma = ctx[k][g[:-1]]
        c = tables[k][g]
        return (c - offs[k][min(c, 3) - 1] if c else 0) / total + gamma * p(g[1:])

    return p


def perplexity(p, t):
    gs = grams(t)
    return math.exp(-sum(math.log(p(g)) for g in gs) / len(gs)) if gs else None


def fold(t):
    return kn.fold_of(kn.normal((t or "").encode()))


def sample():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice(["ka", "lo", "é", "sch", "t"]) for _ in range(rnd.randint(1, 5)))
    rows = [(i, " ".join(word() for _ in range(rnd.choice([3, 40]))), rnd.choice(["aa", "bb"])) for i in range(60)]
    return [*rows, (70, None, "aa"), (71, " \n", "aa"), (72, "ZZZ###", None), (73, "qqq " * 20_000, "bb"), (74, "x", "cc"), (74, "x", "cc"), (None, "ka lo", "aa")]


@pytest.mark.parametrize("bound, block", [(kn.SHARD, kn.BLOCK), (300, 1000)])
def test_against_recursion(spark, bound, block, monkeypatch):
    monkeypatch.setattr(kn, "REQUESTS", 1)
    monkeypatch.setattr(kn, "BLOCK", block)
    rows = sample()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    ids = spark.createDataFrame([(i,) for i in range(0, 60, 2)] * 2 + [(None,)], "doc_id long")
    trusted = [t for d, t, _ in rows if d is not None and d < 60 and d % 2 == 0]
    models = [reference([t for t in trusted if fold(t) != f]) for f in (0, 1)]  # by the fold that they score
    assert sum(models[0](b"ka" + bytes([c])) for c in range(256)) == pytest.approx(1)
    got = kn.classify(docs, ids, 0.9, bound).collect()
    want = [(d, perplexity(models[fold(t)], t)) for d, t, _ in rows]
    key = lambda x: (str(x[0]), x[1] or 0)
    for (a, x), (b, y) in zip(sorted(((r.doc_id, r.perplexity) for r in got), key=key), sorted(want, key=key), strict=True):
        assert a == b and x == (y if y is None else pytest.approx(y, rel=1e-5))
    by = {r.doc_id: r for r in got}
    assert not by[70].kept and not by[71].kept and by[74].kept and by[72].kept  # a language without trusted text has its own quantile
    for lang in ("aa", "bb"):
        mine = [r for r in got if r.lang == lang and r.doc_id is not None and r.doc_id < 60 and r.doc_id % 2 == 0]
        assert 0.9 <= sum(r.kept for r in mine) / len(mine) < 1


def test_shards_stay_within_their_bound(spark, monkeypatch):
    monkeypatch.setattr(kn, "BLOCK", 4000)
    monkeypatch.setattr(kn, "FAN", 3)  # counts are added up in several rounds
    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choice("abcdefgh ") for _ in range(400)), "aa") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    blocks, remove = kn.stored(kn.pack(docs))
    whole = {f: Counter(g for _, t, _ in rows if fold(t) == f for g in grams(t)) for f in (0, 1)}
    for bound in (1000, 2500):
        held, shards, n = kn.counts(blocks, docs, bound)
        got = {0: Counter(), 1: Counter()}
        for r in held.collect():
            g, c = kn.decoded(bytes(r.data))
            assert len(g) <= bound and r.shard < n and set(shards[r.fold][kn.pair(g)]) == {r.shard}
            got[r.fold].update({int(x).to_bytes(5, "big"): int(y) for x, y in zip(g, c)})
        assert got == whole
    remove()


def test_one_python_node_a_stage(spark):
    """However many shards there are, no plan stacks one Python operator upon another or shuffles the blocks."""
    rows = sample()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    blocks, remove = kn.stored(kn.pack(docs))
    plans = []
    for bound in (kn.SHARD, 200):
        plan = kn.perplexities(blocks, *kn.counts(blocks, docs, bound))._jdf.queryExecution().executedPlan().toString()
        plans.append([sum(x in line for line in plan.split("\n")) for x in ("MapInArrow", "CoGroup", "Exchange")])
    assert plans[0] == plans[1] == [1, 2, 3]
    remove()


def test_no_trusted_text_one_fold_and_empty(spark):
    docs = spark.createDataFrame([(1, "abc de", "aa", None)], SCHEMA)
    none = docs.limit(0)
    (r,) = kn.classify(docs, none).collect()
    assert r.perplexity == pytest.approx(256, rel=1e-5) and r.kept
    assert kn.classify(none, none).count() == 0
    (r,) = kn.classify(docs, docs).collect()  # all trusted text lies in one fold, whose model scores it
    assert r.perplexity == pytest.approx(perplexity(reference(["abc de"]), "abc de"), rel=1e-5)


def test_pieces_cover_the_text(monkeypatch):
    monkeypatch.setattr(kn, "PIECE", 7)
    text = kn.normal(b" one\ttwo  three four ")
    whole = b"    one two three four "
    assert b"".join(x[kn.ORDER - 1 :] for x in kn.pieces(text)) == whole[4:]
    assert [int(g).to_bytes(5, "big") for held, _ in kn.gathered([text, b""]) for g in kn.running(held)[0]] == [whole[i : i + 5] for i in range(len(whole) - 4)]


def test_blocks_hold_every_document(spark, monkeypatch):
    rows = sample()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = kn.pack(docs).toArrow()
    held = [(i, t) for r in range(got.num_rows) for one in [got.slice(r, 1)] for i, t in zip(one.column("ids")[0].as_py(), kn.unpack(one))]
    assert sorted(map(str, held)) == sorted(str((d, kn.normal((t or "").encode()))) for d, t, _ in rows)
    assert isinstance(got, pa.Table) and docs.where(F.col("doc_id").isNull()).count() == 1


def test_query_tells_shuffled_words_from_prose(spark, tmp_path):
    from millrace.llm import queries

    prose = "red foxes run over old hills while we sit near them"
    mixed = " ".join(random.Random(4).sample(prose.split(), 11))
    spark.createDataFrame([(i, f"{prose} {i % 5}", "aa") for i in range(50)] + [(50, mixed, "aa")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.op8_perplexity(spark, str(tmp_path)).collect()}
    assert got[50].perplexity > 1.2 * got[0].perplexity and got[0].kept and not got[50].kept
