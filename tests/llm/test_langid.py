import random

import numpy as np

from millrace.llm import langid

SYL = {"aa": ["ka", "lo", "mi"], "bb": ["é", "eau", "tion"], "cc": ["sch", "ung", "ei"]}


def text(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYL[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def sample():
    rnd = random.Random(1)
    rows = [(i, text(rnd, lang := rnd.choice(list(SYL)), rnd.choice([5, 60])), lang, "clash") for i in range(400)]
    return [*rows, (500, None, "aa", None), (501, "", "aa", None), (502, "123 --- 4", "bb", None), (503, "— —", None, None), (None, "ung ei", "cc", None), (504, text(rnd, "bb", 30_000), None, None), (505, text(rnd, "aa", 3000), None, None), (505, text(rnd, "aa", 3000), None, None)]


def test_forward_backward_against_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    e, trans, first = rng.random((5, 3)) + 0.1, rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    post, _ = langid.forward_backward(e, np.array([0, 4]), np.array([4, 1]), trans, first)
    want = np.zeros((4, 3))
    for y in itertools.product(range(3), repeat=4):
        p = first[y[0]] * np.prod([e[t, y[t]] for t in range(4)]) * np.prod([trans[a, b] for a, b in zip(y, y[1:])])
        for t in range(4):
            want[t, y[t]] += p
    assert np.allclose(post[:4], want / want.sum(axis=1, keepdims=True))
    assert np.allclose(post[4], first * e[4] / (first * e[4]).sum())


def test_long_chains_are_not_cut(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = np.array([1, 40, 7, 5, 6, 131])
    e = (rng.random((sizes.sum(), 3)) ** 4 + 1e-6).astype(np.float32)
    trans, first = np.exp(rng.normal(size=(3, 3)) * 2).astype(np.float32), rng.random(3).astype(np.float32)
    whole, _ = langid.forward_backward(e, np.cumsum(sizes) - sizes, sizes, trans, first)
    for most in (32, 2):
        monkeypatch.setattr(langid, "MOST", most)
        for seq in (1, 5, 64, 10**6):
            monkeypatch.setattr(langid, "SEQ", seq)
            assert np.allclose(langid.posteriors(e, sizes, trans, first), whole, atol=1e-5)


def test_long_training_texts_are_read_in_parts(spark, monkeypatch):
    monkeypatch.setattr(langid, "PARTS", 4)
    monkeypatch.setattr(langid, "PART", 8)
    docs = spark.createDataFrame([(3, "0123456789" * 10, "aa"), (4, "short", "aa"), (4, "other", "aa")], "doc_id long, text string, lang string")
    assert not docs.where(langid.held_out()).count()
    assert sorted(langid.sample(docs)[0]) == [("01234567 01234567 12345678 23456789", "aa"), ("other", "aa")]


def test_held_out_accuracy_and_edges(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.predict(docs, ["doc_id", "lang", "score"]).toDF("doc_id", "lang", "extra", "lang_pred", "score", "n").collect()
    by = {r.doc_id: r for r in got}
    held = [r.doc_id for r in docs.where(langid.held_out()).collect()]
    ok = [by[i].lang_pred == by[i].lang for i in held if i < 400]
    assert len(ok) > 50 and np.mean(ok) > 0.98
    assert [by[i].lang_pred for i in (500, 501, 502, 503)] == ["und"] * 4 and by[500].score == 0
    assert by[None].lang_pred == "cc" and by[504].lang_pred == "bb" and by[505].lang_pred == "aa"
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)


def test_code_switching():
    rnd = random.Random(2)
    model = langid.train([(text(rnd, lang, 80), lang) for lang in SYL for _ in range(30)], sorted(SYL))
    p = langid.Labeller(model).shares([text(rnd, "aa", 300) + " " + text(rnd, "cc", 100), None])
    assert p[1] is None and abs(p[0][0] - 0.75) < 0.05 and abs(p[0][2] - 0.25) < 0.05
    assert (np.diag(model["trans"]) > model["trans"].max(axis=1) * 0.999).all()


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[1:3] for r in langid.predict(docs).collect()] == [("und", 0.0)]
    assert langid.predict(docs.limit(0)).count() == 0 and langid.accepted(docs).count() == 0


def test_long_documents_leave_other_labels_their_words(monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_WORDS", 3000)
    rnd = random.Random(5)
    rows = [(text(rnd, "aa", 20_000), "aa"), *((text(rnd, lang, 50), lang) for lang in ("bb", "cc") for _ in range(30))]
    p = langid.Labeller(langid.train(rows, sorted(SYL))).shares([text(rnd, lang, 100) for lang in SYL])
    assert [int(x.argmax()) for x in p] == [0, 1, 2]


def test_word_budgets(monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_WORDS", 100)
    assert langid.budgets([1000, 10, 5, 500], ["a", "a", "b", "b"]) == [40, 10, 5, 45]
    assert langid.budgets([1000, 3], ["a", "b"]) == [97, 3] and langid.budgets([4, 0], ["a", "b"]) == [4, 0]
    for size, n in ((1000, 97), (98, 97), (50, 49), (30, 1), (5, 9), (3, 0)):
        got = langid.spread(list(range(size)), n)
        assert len(got) == min(size, n) and got == sorted(set(got))
    assert max(langid.spread(list(range(1000)), 97)) > 790
