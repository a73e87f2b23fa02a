import random

from millrace.llm import linededup

SCHEMA = "doc_id long, text string, n_chars long, at string"


def brute(rows):
    """Repeated windows over a whole corpus, one after the other."""
    docs = sorted({(d is not None, d or 0, t) for d, t in rows if t is not None})
    assert len({(a, b) for a, b, _ in docs}) == len(docs)
    seen, gone = set(), {}
    for a, d, t in docs:
        full = [(i, x.strip(" \t\v\f\r")) for i, x in enumerate(t.split("\n")) if x.strip(" \t\v\f\r")]
        out = set()
        for p in range(len(full) - 2):
            key = tuple(k for _, k in full[p : p + 3])
            if key in seen:
                out |= {p, p + 1, p + 2}
            seen.add(key)
        lines, n, kept = t.split("\n"), len(full), []
        order = {i: p for p, (i, _) in enumerate(full)}
        for i, x in enumerate(lines):
            if i in order:
                if order[i] not in out:
                    kept.append(x)
            else:
                before = max((p for j, p in order.items() if j < i), default=None)
                after = min((p for j, p in order.items() if j > i), default=None)
                if not (before in out and after in out):
                    kept.append(x)
        gone[(a, d, t)] = ("\n".join(kept) if out else t, n, len(out))
    return sorted([(d, *(gone[(d is not None, d or 0, t)] if t is not None else (None, 0, 0))) for d, t in rows], key=str)


def sample():
    rnd = random.Random(5)
    pool = [f"line {i} is here" for i in range(14)] + ["", "  ", "\ttabbed line ", "tabbed line"]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.choice([0, 1, 2, 5, 30])))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a\nb\nc"), (103, "a\nb\nc"), (104, "a\nb\nc\na\nb\nc\nd"), (105, "x\nx\nx\nx\nx"), (None, "a\nb\nc\nq"), (106, "z\ny\nw\nv"), (106, "z\ny\nw\nv")]
    rows += [(200, "\n".join(f"long {i}" for i in range(5000))), (201, "\n".join(f"long {i}" for i in range(1, 5001)) + "\r")]
    return rows


def test_against_brute_force(spark):
    rows = sample()
    docs = spark.createDataFrame([(d, t, None if t is None else len(t), "clash") for d, t in rows], SCHEMA)
    got = linededup.dedup(docs, counts=True)
    assert got.columns == ["doc_id", "text", "n_chars", "at", "n_lines", "n_removed"]
    got = got.collect()
    assert sorted([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got], key=str) == brute(rows)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_empty(spark):
    assert linededup.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
