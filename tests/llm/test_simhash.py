import random
import re

import xxhash

from millrace.llm import simhash

SCHEMA = "doc_id long, text string, fp string"


def brute(rows):
    fps = []
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted([(d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)], key=str)


def sample():
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(300)] + ["Ünï", "É"]
    rows = []
    for g in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([2, 5, 200, 900]))]
        for _ in range(rnd.choice([1, 2, 9])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((len(rows) * 3 % 101, rnd.choice([" ", "\t\n"]).join(w)))
    return [*rows, (500, None), (501, ""), (502, " \n"), (503, "one"), (503, "one"), (None, "ONE"), (None, "null id"), (600, "x " * 50_000)]


def test_against_brute_force(spark):
    rows = sample()
    got = simhash.near_duplicates(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_hot_buckets_lose_no_link(spark):
    """Hundreds of fingerprints in a chain of buckets, with the pair path all but switched off."""
    rnd = random.Random(3)
    seen = {0}
    for _ in range(150):
        x = rnd.choice(sorted(seen))
        seen.add(x ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64))
    seen |= {rnd.getrandbits(64) for _ in range(50)}
    fps = spark.createDataFrame([(simhash.signed(x),) for x in seen], "fp long")
    for hot in (2, 64):
        got = simhash.connected_components(simhash.links(fps, hot=hot)).collect()
        comp = {}
        for v, root in got:
            comp.setdefault(root, set()).add(v)
        xs, want = sorted(seen), []
        while xs:
            todo, part = [xs.pop()], set()
            while todo:
                x = todo.pop()
                part.add(simhash.signed(x))
                near = [y for y in xs if (x ^ y).bit_count() <= 2]
                xs = [y for y in xs if y not in near]
                todo += near
            if len(part) > 1:
                want.append(part)
        assert sorted(map(sorted, comp.values())) == sorted(map(sorted, want))


def test_thresholds_cover_the_distance():
    import numpy as np

    both = np.full((64, 64), 250.0)
    np.fill_diagonal(both, 500.0)
    for n in (1000, 10**11):
        plan = simhash.allocate(n, both * n / 1000, 2)
        assert sum(t + 1 for _, t in plan) == 3
        bits = [b for p, _ in plan for b in p]
        assert len(bits) == len(set(bits))
    assert simhash.allocate(0, both * 0, 2)


def test_one_of_each_and_empty(spark):
    rows = sample()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({c for _, _, c in brute(rows) if c is not None})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
