"""The stages of the pipeline, one after the other, against brute-force versions of what each must keep."""

import random
import re
from collections import Counter

import test_decontaminate
import test_linededup
import test_mixing
import test_simhash

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def corpus():
    rnd = random.Random(12)
    vocab = {"aa": [a + b for a in ("ka", "lo", "mi", "re") for b in ("ta", "no", "sa", "vi", "ko")], "bb": [a + b for a in ("sch", "ung", "ver") for b in ("eit", "ach", "tz", "ein", "pf", "lich")]}
    text = lambda lang, n: "\n".join(" ".join(rnd.choice(vocab[lang]) for _ in range(rnd.randint(4, 12))) for _ in range(n))
    rows = []
    for i in range(80):
        lang = rnd.choice(["aa", "bb"])
        rows.append((i, text(lang, 15 if i == 5 else rnd.choice([2, 6, 15])), lang, rnd.choice(["s1", "s2", "s3", None])))
    item = "the answer to this one question is forty two and nothing else at all"
    shared = text("aa", 4)
    rows += [(100 + k, f"{text('aa', 5)}\n{shared}\n{text('aa', 3)}", "aa", "s1") for k in range(3)]
    rows += [(200, rows[5][1], rows[5][2], "s2"), (201, rows[5][1] + " kata", rows[5][2], "s2"), (202, rows[5][1], rows[5][2], "s2")]
    rows += [(300, f"{text('bb', 6)} {item.title()}! {text('bb', 6)}", "bb", "s3"), (301, item, "aa", "s1"), (400, None, "aa", "s1"), (401, "--- 123 ---", "bb", "s2"), (402, "", None, None)]
    return rows, [(1, item), (2, None)]


def test_stages(spark, tmp_path):
    rows, bench = corpus()
    d = str(tmp_path / "sf")
    spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k < 4:
            assert sorted(out.columns) == sorted(COLUMNS)
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        kept[name] = docs.collect()

    def pairs(name):
        return sorted(((r.doc_id, r.text) for r in kept[name]), key=str)

    first = [(i, t) for i, t, _, _ in rows if re.search("[a-z]", t or "")]
    assert pairs("language_id") == sorted(first, key=str)
    second = [(i, t) for i, t, _, _ in test_linededup.brute(first)]
    assert pairs("line_dedup") == sorted(second, key=str)
    assert any(t == "" for _, t in second) and all(r.n_chars == len(r.text) for r in kept["line_dedup"])
    third = {c for _, _, c in test_simhash.brute(second)}
    assert {i for i, _ in pairs("near_dedup")} == third and len(pairs("near_dedup")) == len(third)
    assert 202 not in third and dict(second)[200] == dict(second)[202] == ""  # emptied copies are one class
    hits = {i: (n, h) for i, n, h, *_ in test_decontaminate.brute(pairs("near_dedup"), bench)}
    fourth = {i for i, (n, h) in hits.items() if h <= 0.5 * n}
    assert {i for i, _ in pairs("decontamination")} == fourth and 300 in fourth and 301 not in fourth
    assert not any(h for _, _, h, *_ in test_decontaminate.brute(pairs("decontamination"), bench))
    assert [x for x in pairs("decontamination") if not hits[x[0]][1]] == [x for x in pairs("near_dedup") if x[0] in fourth and not hits[x[0]][1]]
    have, sizes = {}, Counter()
    for r in kept["decontamination"]:
        have.setdefault(r.source, Counter()).update(words(r.text))
        sizes[r.source] += len(words(r.text))
    used = {s: Counter() for s in have}
    for b in kept["mixing"]:
        assert len(words(b.text)) == b.n_words and set(b.doc_ids) <= fourth
        used[b.source].update(words(b.text))
    for s, target in test_mixing.levels(sizes).items():
        assert abs(sum(used[s].values()) - target) <= 0.5
        assert all(used[s][w] <= 2 * have[s][w] for w in used[s])
    again = sorted(map(str, corpus_pipeline.run(spark, d).collect()))
    assert again == sorted(map(str, kept["mixing"]))


def test_empty_tables_clashing_columns_and_long_texts(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, block long, take string, hits string, fp string"
    bench = spark.createDataFrame([], "item_id long, text string")
    long = "kata lono misa revi " * 40_000
    for name, rows in (("empty", []), ("long", [(1, long, "aa", "s", len(long), 1, "x", "y", "z"), (2, long, "aa", "s", len(long), 1, "x", "y", "z"), (2, long, "aa", "s", len(long), 1, "x", "y", "z"), (None, None, None, None, None, None, None, None, None)])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
        bench.write.parquet(f"{d}/benchmark.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES:
            docs = f(spark, docs, d)
            if stage != "mixing":
                assert docs.columns == spark.read.parquet(f"{d}/documents.parquet").columns
            docs.write.parquet(f"{d}/{stage}")
            docs = spark.read.parquet(f"{d}/{stage}")
        n = sum(r.n_words for r in docs.collect())
        assert n == (0 if name == "empty" else round(1.5 * 160_000))  # of three copies one stays; its source is taken one and a half times


def test_near_dedup_keeps_different_texts_under_one_id(spark):
    a, b, c = "alpha beta gamma delta " * 9, "one two three four five " * 9, "un deux trois quatre " * 9
    rows = [(1, a, "x", "s", 1), (1, b, "x", "s", 2), (2, c, "x", "s", 3), (2, c, "x", "s", 3), (2, c, "y", "s", 3), (3, a, "x", "s", 4), (None, a, "x", "s", 5), (4, None, None, None, None), (4, "", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    got = sorted(((r.doc_id, r.text) for r in stage(spark, docs, None).collect()), key=str)
    assert [x for x in got if x[0] != 4] == sorted([(1, a), (1, b), (2, c), (None, a)], key=str)
    assert len([x for x in got if x[0] == 4]) == 1
    assert sorted(map(str, stage(spark, docs.repartition(3), None).collect())) == sorted(map(str, stage(spark, docs, None).collect()))
