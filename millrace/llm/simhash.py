"""SimHash near-duplicates by the generalised pigeonhole principle.

Defined results: null or wordless texts have fingerprint 0 and link like any other; repeated rows
each get their row; a null doc_id keeps its fingerprint and takes the smallest non-null id that it
reaches (null if there is none); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpoint, connected_components, slices

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
WHITE = frozenset(b" \t\n\v\f\r")
#: Lane i of SPREAD[v] is bit i of the byte v; up to 255 such words can be added without carry.
SPREAD = np.array([sum(((v >> i) & 1) << (8 * i) for i in range(8)) for v in range(256)], dtype=np.uint64)


def runs(text: bytes | None, most: int = 1 << 20):
    """The lower-cased words of a text, in lists from about ``most`` bytes each."""
    x, at = text or b"", 0
    while at < len(x):
        end = min(len(x), at + most)
        while end < len(x) and x[end] not in WHITE:
            end += 1
        w = x[at:end].translate(LOWER).split()
        if w:
            yield w
        at = end


def shingle_hashes(text: bytes | None, n: int):
    """Arrays of the hashes of a text's n-word shingles (of the whole sequence, if shorter), piece by piece."""
    from xxhash import xxh64_intdigest as h

    join, tail, some = b" ".join, [], False
    for w in runs(text):
        w = tail + w
        if len(w) >= n:
            some = True
            yield np.fromiter((h(join(t), SEED) for t in zip(*(w[i:] for i in range(n)))), dtype=np.uint64, count=len(w) - n + 1)
        tail = w[max(0, len(w) - n + 1) :]
    if tail and not some:
        yield np.array([h(join(tail), SEED)], dtype=np.uint64)


def tallies(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each consecutive run of hashes (none is empty), how many have each bit."""
    out = np.zeros((len(sizes), 64), dtype=np.int64)
    pieces = -(-sizes // 255)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(np.cumsum(sizes) - sizes, pieces) + 255 * nth
    ends = np.append(starts[1:], len(hashes))
    for lo in range(0, len(starts), 256):
        s, e = starts[lo : lo + 256], ends[min(lo + 255, len(starts) - 1)]
        lanes = SPREAD[hashes[s[0] : e].view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, s - s[0], axis=0).view(np.uint8).reshape(-1, 64)
        np.add.at(out, owner[lo : lo + 256], sums)
    return out


def majority(texts, n: int, most: int = 100_000) -> np.ndarray:
    """The fingerprint of each text: bits that over half of its shingles' hashes have. Some ``most``
    hashes (or those of one piece of a text) are held at a time."""
    ones, total = np.zeros((len(texts), 64), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    held, owner, size = [], [], 0

    def add():
        sizes = np.array([len(x) for x in held])
        np.add.at(ones, owner, tallies(np.concatenate(held), sizes))
        np.add.at(total, owner, sizes)
        held.clear(), owner.clear()

    for k, t in enumerate(texts):
        for x in shingle_hashes(t.as_py(), n):
            held.append(x)
            owner.append(k)
            size += len(x)
            if size >= most:
                add()
                size = 0
    if held:
        add()
    return np.packbits(ones * 2 > total[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def text_key():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, fp, key): the 64-bit SimHash of each whole text over n-word shingles, repeats counted, and a
    hash of the text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            parts = [majority(part, n) for part in slices(b.column(1).cast(pa.binary()))]
            fps = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), b.column(2)], ["doc_id", "fp", "key"])

    return docs.select("doc_id", "text", text_key().alias("key")).mapInArrow(run, f"doc_id {id_type}, fp long, key long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for every two bits, how many have both: summed over all rows."""

    upper = np.triu_indices(64)

    def run(batches):
        total, rows = np.zeros((64, 64)), 0
        for b in batches:
            x = np.asarray(b.column(0)).view(np.uint8).reshape(-1, 8)
            x = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
            rows += len(x)
        if rows:
            both = np.append(total[upper], rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both))), pa.array(both.astype(np.int64))], ["k", "v"])

    rows = fps.select("fp").mapInArrow(run, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()
    got = {r.k: r.v for r in rows}
    both = np.zeros((64, 64))
    both[upper] = [got.get(k, 0) for k in range(len(upper[0]))]
    return got.get(len(upper[0]), 0), np.maximum(both, both.T)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of near-equal width; each takes in turn the free bit most correlated with its own."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    free, parts = set(range(64)), []
    for i in range(m):
        width = len(free) // (m - i)
        part = [min(free, key=lambda b: (abs(p[b] - 0.5), b))]
        free.discard(part[0])
        while len(part) < width:
            best = max(free, key=lambda b: (r[b, part].sum(), -b))
            part.append(best)
            free.discard(best)
        parts.append(sorted(part))
    return parts


def estimate(n: int, both: np.ndarray, part: list[int], t: int) -> float:
    """Pairs within t bits on part (a Poisson binomial of the bits' mismatch rates) plus probe keys."""
    if t < 0:
        return 0.0
    p = np.diag(both)[part] / max(n, 1)
    dist = np.array([1.0] + [0.0] * t)
    for q in 2 * p * (1 - p):
        dist = dist * (1 - q) + np.append(0.0, dist[:-1]) * q
    return n * (n - 1) / 2 * float(dist.sum()) + n * sum(math.comb(len(part), j) for j in range(t + 1))


def allocate(n: int, both: np.ndarray, tau: int, sizes=(2, 3, 4)) -> list[tuple[list[int], int]]:
    """Partitions and their thresholds: for each m, dynamic programming over thresholds that sum to
    tau - m + 1 (-1: the partition isn't probed); the m with the least estimated cost wins."""
    best = None
    for m in sizes:
        parts = group_bits(n, both, m)
        table = {0: (0.0, [])}  # sum of (threshold + 1) so far -> cost, thresholds
        for part in parts:
            grown = {}
            for used, (cost, ts) in table.items():
                for t in range(-1, min(1, tau - used) + 1):
                    key, c = used + t + 1, cost + estimate(n, both, part, t)
                    if key <= tau + 1 and (key not in grown or c < grown[key][0]):
                        grown[key] = (c, [*ts, t])
            table = grown
        if tau + 1 in table and (best is None or table[tau + 1][0] < best[0]):
            best = (table[tau + 1][0], list(zip(parts, table[tau + 1][1])))
    return [(p, t) for p, t in best[1] if t >= 0]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def links(fps: DataFrame, tau: int = 2, hot: int = 64) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within tau (2 at most) differing bits.

    A bucket of one probed key with up to ``hot`` members is verified pair by pair. Members of larger
    buckets are joined exactly without pairs: two fingerprints differ in 2 bits or fewer if and only if
    some point is within 1 bit of both, so each is dealt to its 65 such points, and each point (65
    members at most) links what meets there to its smallest member.
    """
    n, both = bit_statistics(fps)
    plan = allocate(n, both, tau)
    cases = []
    for i, (part, t) in enumerate(plan):
        mask = signed(sum(1 << b for b in part))
        key = F.col("fp").bitwiseAND(F.lit(mask))
        cases.append(F.array(F.struct(F.lit(i).alias("part"), key.alias("key"), F.lit(True).alias("base"))))
        if t >= 1:  # a pair that differs in one bit of the part meets once, where the bit is set
            flips = F.array(*(F.lit(signed(1 << b)) for b in part))
            cases.append(F.transform(F.filter(flips, lambda f: F.col("fp").bitwiseAND(f) == 0), lambda f: F.struct(F.lit(i).alias("part"), key.bitwiseOR(f).alias("key"), F.lit(False).alias("base"))))
    probes = fps.select("fp", F.explode(F.concat(*cases)).alias("s")).select("fp", "s.*")
    sizes = probes.groupBy("part", "key").agg(F.count("*").alias("n"), F.max("base").alias("any_base")).where("n > 1 and any_base")
    probes = checkpoint(probes.join(sizes.select("part", "key", "n").hint("merge"), ["part", "key"]))
    cold = probes.where(F.col("n") <= hot)
    a, b = cold.select("part", "key", F.col("fp").alias("a"), F.col("base").alias("abase")), cold.where("base").select("part", "key", F.col("fp").alias("b"))
    pairs = a.join(b.hint("merge"), ["part", "key"]).where("(not abase or a < b) and bit_count(a ^ b) between 1 and %d" % tau).select("a", "b")
    near = F.concat(F.array(F.col("fp")), F.transform(F.array(*(F.lit(signed(1 << i)) for i in range(64))), lambda f: F.col("fp").bitwiseXOR(f)))
    balls = probes.where(F.col("n") > hot).select("fp").distinct().select("fp", F.explode(near).alias("point"))
    met = balls.groupBy("point").agg(F.collect_list("fp").alias("m")).where("size(m) > 1")
    stars = met.select(F.explode("m").alias("a"), F.array_min("m").alias("b")).where("a <> b")
    return pairs.unionByName(stars)


def grouped(docs: DataFrame, n: int = 3, tau: int = 2) -> DataFrame:
    """(doc_id, fp, key, root, component_id) of every row of docs: key is a hash of its text, root tells its class."""
    fps = checkpoint(fingerprints(docs, n))
    reps = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = checkpoint(connected_components(links(reps.select("fp"), tau)))
    ids = reps.join(roots.hint("merge"), reps.fp == roots.v, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = ids.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = ids.join(least.hint("merge"), "root").select("fp", "root", "component_id")
    return fps.join(of.hint("merge"), "fp").select("doc_id", "fp", "key", "root", "component_id")


def near_duplicates(docs: DataFrame, n: int = 3, tau: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs."""
    return grouped(docs, n, tau).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each class one row with its smallest doc_id stays (if that has several
    texts in the class, the one with the smallest hash; of rows with one id and text, the one whose columns
    hash smallest). Rows without a doc_id stay. Other texts under the same id are classes of their own."""
    kept = grouped(docs).where("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("x")).select("x.doc_id", "x.key").distinct()
    # The kept rows grow with the documents: a sort-merge join at every size.
    named = docs.where("doc_id is not null").withColumn("__key", text_key())
    named = named.join(kept.withColumnRenamed("key", "__key").hint("merge"), ["doc_id", "__key"], "left_semi")
    one = named.groupBy("doc_id", "__key").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row")).select("__row.*")
    return one.select(docs.columns).unionByName(docs.where("doc_id is null"))
