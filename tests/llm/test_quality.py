import math
import random
import re
import struct
from collections import Counter

import pytest
import xxhash

from millrace.llm import quality

SCHEMA = "doc_id long, text string, llr string"


def h64(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def grams(ws):
    hs = [h64(w.encode()) for w in ws]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    pair = lambda a, b: signed(h64(struct.pack("<Q", b), h64(struct.pack("<Q", a)))) % quality.BUCKETS
    return [signed(h) % quality.BUCKETS for h in hs] + [pair(a, b) for a, b in zip(hs, hs[1:])]


def brute(rows, trusted, threshold):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    target, raw = Counter(), Counter()
    for d, t in rows:
        g = grams(split(t))
        raw.update(g)
        if d is not None and d in trusted:
            target.update(g)
    nt, nr, k = sum(target.values()), sum(raw.values()), quality.SMOOTH * quality.BUCKETS
    out = []
    for d, t in rows:
        w = split(t)
        lines = [x for x in (t or "").split("\n") if split(x)]
        grams8 = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        many = Counter(grams8)
        rep = {j for i, g in enumerate(grams8) if many[g] > 1 for j in range(i, i + 8)}
        g = grams(w)
        score = sum(math.log((target[b] + quality.SMOOTH) / (nt + k)) - math.log((raw[b] + quality.SMOOTH) / (nr + k)) for b in g) / len(g) if g and nt else 0.0
        failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
        out.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(rep), failed, not failed and score >= threshold, pytest.approx(score)))
    return sorted(out, key=lambda r: str(r[:8]))


def sample():
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(40)] + ["é|x", "#a&&"]
    rows = [(i, "".join(rnd.choice(vocab) + rnd.choice([" ", "\n", " \t", " "]) for _ in range(rnd.choice([0, 3, 30, 200])))) for i in range(50)]
    rows += [(60, None), (61, ""), (62, " \n "), (63, "a b c d e f g h " * 30), (64, "x " * 9), (64, "x " * 9), (None, "a\na\nb"), (65, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9"), (66, "y " * 30_000 + " ".join(map(str, range(30_000))))]
    return rows


@pytest.mark.parametrize("trusted", [set(range(0, 60, 2)), set()])
def test_against_brute_force(spark, trusted):
    rows = sample()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    ids = spark.createDataFrame([(i,) for i in trusted] * 2 + [(None,)], "doc_id long")
    got = quality.rules(docs, quality.ratios(docs, ids), 0.0)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    got = sorted([tuple(r) for r in got.select(*names).collect()], key=lambda r: str(r[:8]))
    assert got == brute(rows, trusted, 0.0)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert quality.rules(docs, quality.ratios(docs, docs), 0.0).count() == 0
