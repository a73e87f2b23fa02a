import hashlib
import random
import re

from pyspark.sql import functions as F

from millrace.llm import decontaminate

DOCS = "doc_id long, text string, items string, n_words string"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, bench):
    windows = {}
    for i, t in bench:
        w = words(t)
        for p in range(max(1, len(w) - 9)) if w else []:
            windows.setdefault(tuple(w[p : p + 10]), set()).add(i)
    sizes = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[p : p + n]))) is not None:
                    hit |= set(range(p, p + n))
                    items |= got
        names = sorted(str(i) for i in items if i is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def sample():
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(12)] + ["É", "über"]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    bench = [(i, text(rnd.choice([3, 10, 11, 30]))) for i in range(40)]
    bench += [(40, "one TWO"), (41, None), (42, ""), (43, "..."), (None, "nameless item of ten words that nobody can ever tell"), (44, "one two"), (44, "one two")]
    docs = [(i, text(rnd.choice([0, 2, 40, 300]))) for i in range(40)]
    docs += [(100 + i, f"Intro, {b}! outro") for i, (_, b) in enumerate(bench) if b] + [(200, None), (200, ""), (None, "x one,two y"), (201, "one. " * 20_000 + "two")]
    return docs, bench


def digest(found):
    ids = F.array_sort("items")
    n = decontaminate.n_hit()
    return sorted([tuple(r) for r in found.select("doc_id", "n_words", n, F.size(ids), F.sha2(F.array_join(ids, ","), 256), n > 0).collect()], key=str)


def test_against_brute_force(spark):
    docs, bench = sample()
    d = spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], DOCS)
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = brute(docs, bench)
    for bound in (100_000, 40):  # one automaton; several, one after the other
        assert digest(decontaminate.scan(d, b, keep=["doc_id"], group_words=bound)) == want


def test_cut_and_empty(spark):
    docs, bench = sample()
    item = "the quick brown fox jumps over the lazy dog again and again"
    d = spark.createDataFrame([(1, f"Über allem. {item.upper()}, and then forty more words that are {'clean ' * 30}", "c", "c"), (2, item, "c", "c"), (3, "clean text", None, None), (4, None, None, None)], DOCS)
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(d, b).collect()}
    assert sorted(got) == [1, 3, 4]
    assert got[1].text.startswith("Über allem.  , and then forty") and got[3].text == "clean text"
    assert got[1].asDict().keys() == {"doc_id", "text", "items", "n_words"}
    none = decontaminate.scan(d, b.limit(0)).collect()
    assert len(none) == 4 and not any(r["hits"] for r in none)
    assert decontaminate.scan(d.limit(0), b).count() == 0


def test_one_python_node_a_stage(spark):
    docs, bench = sample()
    docs = spark.createDataFrame([(d, t, None, None) for d, t in docs], DOCS)
    bench = spark.createDataFrame(bench, "item_id long, text string")
    want = None
    for bound in (10**6, 100):
        got = decontaminate.scan(docs, bench, keep=["doc_id"], group_words=bound)
        assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        rows = sorted(map(str, got.collect()))
        want = want or rows
        assert [r.split("longest")[0] for r in rows] == [r.split("longest")[0] for r in want]
