"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model.

The model is one of bytes: a text is read as its words with a space after each, every byte predicted
from the ORDER - 1 before it, with spaces before the text. Contexts run on over the words. Counts cover all
trusted text; continuation counts, discounts (Chen and Goodman 1999) and lower orders follow from them.

No document is scored by a model that has seen it: texts fall into two folds by a hash of their words, and
each fold is scored by the model of the other's trusted texts (by that of all of them, if they lie in one
fold). So trusted documents and others are held against the threshold alike.

Counts are joined by shard. Texts are packed into compressed blocks of bounded size, which stay where they are
(a bucketed table). A shard holds the counts of all n-grams whose contexts end in the same two bytes, and with
them all that the orders 3 to 5 need; blocks add theirs up by shard, then ask for the n-grams that they hold,
one packed row a shard; shards answer with log probabilities, which meet the blocks again. Nothing that
grows is sent to the driver or broadcast: orders 1 and 2 (65,536 n-grams at most) and the shards of byte
pairs go out with the code.

A document is kept if its perplexity is at most its language's threshold: a quantile of the perplexities
of that language's trusted documents (of all its documents if none is trusted).

Defined results: null texts and texts without words have no perplexity and are not kept; without any
trusted text every byte has probability 1/256; a null lang is a language of its own; a null doc_id is
never trusted; repeated rows count and are returned each, with equal perplexities; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import checkpoint, shared_folder, slices

ORDER = 5
#: Of compression of the blocks.
LEVEL = 5
PAD = b" " * (ORDER - 1)
#: Bytes of text in a block (a longer text is a block of its own), and of those looked up at a time.
BLOCK, PIECE = 16 << 20, 1 << 20
#: N-grams of a shard (more only where one pair of bytes has more: 256^3 at most), shards of a fold at least,
#: requests of full blocks that a part of a shard answers, rows of a shard's counts added up at a time.
SHARD, LEAST, REQUESTS, FAN = 2_000_000, 8, 32, 256
TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def mask(k: int) -> int:
    return (1 << 8 * k) - 1


def normal(text: bytes | None) -> bytes:
    """The words of a text with a space after each."""
    w = (text or b"").split()
    return b" ".join(w) + b" " if w else b""


def pieces(text: bytes):
    """A normalised text in pieces of PIECE predicted bytes or fewer, each behind the ORDER - 1 bytes
    before it (spaces before the first)."""
    x = PAD + text
    for at in range(0, len(text), PIECE):
        yield x[at : at + PIECE + ORDER - 1]


def gathered(texts):
    """(pieces, numbers of their texts) of about PIECE bytes."""
    held, owners, size = [], [], 0
    for i, t in enumerate(texts):
        for x in pieces(t):
            held.append(x)
            owners.append(i)
            size += len(x)
            if size >= PIECE:
                yield held, owners
                held, owners, size = [], [], 0
    if held:
        yield held, owners


def running(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One n-gram of ORDER bytes for each predicted byte of each piece, and where each piece's begin."""
    sizes = np.fromiter(map(len, held), dtype=np.int64, count=len(held))
    x = np.frombuffer(b"".join(held), dtype=np.uint8).astype(np.int64)
    key = np.zeros(len(x) - ORDER + 1, dtype=np.int64)
    for j in range(ORDER):
        key = key << 8 | x[j : len(x) - ORDER + 1 + j]
    real, ends = np.ones(len(key), bool), np.cumsum(sizes)[:-1]
    for j in range(1, ORDER):
        real[ends - j] = False
    sizes -= ORDER - 1
    return key[real], np.cumsum(sizes) - sizes


def distinct(texts) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the texts in order, and how often each occurs."""
    grams, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for held, _ in gathered(texts):
        g, c = np.unique(running(held)[0], return_counts=True)
        grams.append(g)
        counts.append(c)
    g, at = np.unique(np.concatenate(grams), return_inverse=True)
    return g, np.bincount(at, weights=np.concatenate(counts), minlength=len(g)).astype(np.int64)


def fold_of(text: bytes) -> int:
    return zlib.crc32(text) & 1


def part_of(block: int, parts: int) -> int:
    return zlib.crc32(block.to_bytes(8, "big")) % parts


def pack(docs: DataFrame) -> DataFrame:
    """(block, fold, ids, langs, sizes, data): the documents in blocks of one fold; data holds their
    normalised texts, compressed, of the given sizes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["block", "fold", "ids", "langs", "sizes", "data"]

    def run(batches):
        zstd, made = zstandard.ZstdCompressor(level=LEVEL), 0
        first = TaskContext.get().partitionId() << 32
        held: list = [([], [], []), ([], [], [])]
        full, id_type = [0, 0], None

        def emit(fold):
            nonlocal made
            ids, langs, texts = held[fold]
            row = [[first + made], [fold], pa.array([ids], pa.list_(id_type)), pa.array([langs], pa.list_(pa.string())), pa.array([list(map(len, texts))], pa.list_(pa.int32())), [zstd.compress(b"".join(texts))]]
            made, held[fold], full[fold] = made + 1, ([], [], []), 0
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(row, [pa.int64(), pa.int32(), None, None, None, pa.binary()])], names)

        for b in batches:
            id_type, at = b.column(0).type, 0
            for part in slices(b.column(2).cast(pa.binary())):
                ids, langs = b.column(0).slice(at, len(part)).to_pylist(), b.column(1).slice(at, len(part)).to_pylist()
                at += len(part)
                for i, lang, t in zip(ids, langs, part):
                    t = normal(t.as_py())
                    f = fold_of(t)
                    for x, y in zip(held[f], (i, lang, t)):
                        x.append(y)
                    full[f] += len(t)
                    if full[f] >= BLOCK:
                        yield emit(f)
        for f in (0, 1):
            if held[f][0]:
                yield emit(f)

    return docs.select("doc_id", "lang", "text").mapInArrow(run, f"block long, fold int, ids array<{kind}>, langs array<string>, sizes array<int>, data binary")


def unpack(table: pa.Table) -> list[bytes]:
    """The texts of a block."""
    x, at, out = zstandard.ZstdDecompressor().decompress(table.column("data")[0].as_py()), 0, []
    for n in table.column("sizes")[0].as_py():
        out.append(x[at : at + n])
        at += n
    return out


def stored(blocks: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """The blocks as a table in the shared folder, bucketed by block: what meets them by block comes to
    them, and they are not shuffled. And a function that removes it."""
    spark = blocks.sparkSession
    name = f"perplexity_blocks_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks.write.bucketBy(n, "block").option("path", path).option("compression", "none").saveAsTable(name)

    def remove():
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    return spark.table(name), remove


def positions(blocks: DataFrame, trusted: DataFrame) -> DataFrame:
    """(at, pos): the places of trusted documents. Ids, not texts, meet the trusted ones, which grow with
    the documents: a sort-merge join at every size."""
    ids = trusted.where("doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    return blocks.select(F.col("block").alias("at"), F.posexplode("ids").alias("pos", "id")).join(ids.hint("merge"), "id", "left_semi").select("at", "pos")


def of_trusted(blocks: DataFrame, at: DataFrame, make, schema: str) -> DataFrame:
    """make(fold, n-grams, counts) of the trusted texts of each block, as (fold, ...) rows of the schema."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(left, right):
        rows: list = []
        if left.num_rows and right.num_rows:
            texts = unpack(left)
            g, c = distinct(texts[p] for p in right.column("pos").to_pylist())
            if len(g):
                fold = left.column("fold")[0].as_py()
                rows = [(fold, *r) for r in make(left.column("block")[0].as_py(), fold, g, c)]
        return pa.table([pa.array([r[i] for r in rows], TYPES[x.split()[1]]) for i, x in enumerate(schema.split(", "))], names)

    return blocks.select("block", "fold", "sizes", "data").groupBy("block").cogroup(at.groupBy("at")).applyInArrow(run, schema)


def coded(g: np.ndarray, c: np.ndarray) -> bytes:
    """Ordered n-grams and their counts, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([np.diff(g, prepend=0), c]).tobytes())


def decoded(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.int64).reshape(2, -1)
    return np.cumsum(x[0]), x[1]


def merged(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of coded counts, pair by pair, so that the rows of a part are not all open at once."""
    g, c = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for data in parts:
        h, d = decoded(data)
        new, at = np.unique(np.concatenate([g, h]), return_inverse=True)
        g, c = new, np.bincount(at, weights=np.concatenate([c, d]), minlength=len(new)).astype(np.int64)
    return g, c


def dealt(sizes: list[tuple[int, int, int]], bound: int) -> tuple[np.ndarray, int]:
    """The shard of each fold's byte pairs, and the number of shards of a fold, from (n-grams, fold, pair):
    pairs fill shards of up to ``bound`` n-grams, the largest first."""
    shards = np.tile(np.arange(1 << 16) % LEAST, (2, 1))  # pairs that the model lacks go anywhere
    most = LEAST
    for fold in (0, 1):
        mine = sorted(((n, p) for n, f, p in sizes if f == fold), reverse=True)
        room = min(bound, max(1, -(-sum(n for n, _ in mine) // LEAST)))
        shard, left = -1, 0
        for n, p in mine:
            if n > left:
                shard, left = shard + 1, room
            shards[fold, p] = shard
            left -= n
        most = max(most, shard + 1)
    return shards, most


def counts(blocks: DataFrame, trusted: DataFrame, bound: int = SHARD) -> tuple[DataFrame, np.ndarray, int]:
    """((fold, shard, data), shards, n): the counts of all n-grams of all trusted texts, a row a shard,
    and which shard has which byte pairs. Blocks' counts are added up in rounds of FAN at a time."""
    at = checkpoint(positions(blocks, trusted))

    def size(block, fold, g, c):
        p, n = np.unique(pair(g), return_counts=True)
        return zip(p.tolist(), n.tolist())

    # 2 x 65,536 rows at most; what blocks have in common is counted more than once, so shards are smaller.
    sizes = of_trusted(blocks, at, size, "fold int, pair int, n long").groupBy("fold", "pair").agg(F.sum("n").alias("n")).collect()
    shards, n = dealt([(r.n, r.fold, r.pair) for r in sizes], bound)
    parts = -(-blocks.select("block").count() // FAN) or 1

    def split(block, fold, g, c):
        of = shards[fold][pair(g)]
        return [(int(s), part_of(block, parts), coded(g[of == s], c[of == s])) for s in np.unique(of)]

    held = of_trusted(blocks, at, split, "fold int, shard int, part int, data binary")

    def add(t):
        return pa.table({"fold": t.column("fold")[:1], "shard": t.column("shard")[:1], "part": pa.array([t.column("part")[0].as_py() // FAN], pa.int32()), "data": pa.array([coded(*merged(t.column("data").to_pylist()))], pa.binary())})

    while True:
        held = checkpoint(held.groupBy("fold", "shard", "part").applyInArrow(add, held.schema))
        if parts == 1:
            return held.select("fold", "shard", "data"), shards, n
        parts = -(-parts // FAN)


def discounts(n: dict[int, int]) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams seen once to four times."""
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.1), k + 0.9) for k, d in enumerate(raw)]


def pair(g: np.ndarray) -> np.ndarray:
    """The two bytes before the predicted one."""
    return g >> 8 & 0xFFFF


def shorter(g: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (k - 1)-grams that the k-grams g end in, and how many of g each."""
    return np.unique(g & mask(k - 1), return_counts=True)


def small_counts(held: DataFrame) -> tuple[dict, dict]:
    """By fold: {order: {count: n-grams with it}} up to counts of 4, and the bigrams with their counts (the
    different bytes before them): 65,536 at most."""

    def run(batches):
        for b in batches:
            for fold, data in zip(b.column("fold").to_pylist(), b.column("data")):
                g, c = decoded(data.as_py())
                rows = []
                for k in (5, 4, 3):
                    rows += [(fold, k, int(x), int((c == x).sum())) for x in (1, 2, 3, 4)]
                    g, c = shorter(g, k)
                rows += [(fold, 2, int(x), int(n)) for x, n in zip(g, c)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["fold", "k", "x", "n"])

    few, bigrams = {}, {}
    for r in held.mapInArrow(run, "fold int, k int, x long, n long").groupBy("fold", "k", "x").agg(F.sum("n").alias("n")).collect():
        if r.k == 2:
            bigrams.setdefault(r.fold, {})[r.x] = r.n
        else:
            few.setdefault(r.fold, {}).setdefault(r.k, {})[r.x] = r.n
    return few, bigrams


def tables(k: int, g: np.ndarray, c: np.ndarray, d: list[float], lower) -> dict:
    """{(k, ctx): (sorted keys, values)}: log probabilities of the k-grams g, and log interpolation weights
    of their contexts; lower gives the probabilities of (k - 1)-grams."""
    off = np.array(d)[np.minimum(c, 3) - 1]
    h, at = np.unique(g >> 8, return_inverse=True)
    total, gamma = np.bincount(at, weights=c), np.bincount(at, weights=off)
    p = (c - off) / total[at] + gamma[at] / total[at] * lower(g & mask(k - 1))
    return {(k, False): (g, np.log(p)), (k, True): (h, np.log(gamma / total))}


def base_tables(bigrams: dict, few: dict) -> tuple[dict, dict]:
    """The tables of orders 1 and 2 of a fold, and the discounts of all orders."""
    g2 = np.array(sorted(bigrams), dtype=np.int64)
    c2 = np.array([bigrams[x] for x in g2.tolist()], dtype=np.int64)
    g1, c1 = shorter(g2, 2)
    d = {k: discounts(few.get(k, {})) for k in (3, 4, 5)} | {k: discounts({x: int((c == x).sum()) for x in (1, 2, 3, 4)}) for k, c in ((1, c1), (2, c2))}
    out = tables(1, g1, c1, d[1], lambda s: 1 / 256)
    return out | tables(2, g2, c2, d[2], lambda s: np.exp(find(out[1, False], s)[1])), d


def shard_tables(data: list[bytes], small: dict, d: dict) -> dict:
    """The tables of orders 3 to 5 of a shard, which holds all n-grams whose contexts end in its pairs."""
    g, c = merged(data)
    all_orders = {5: (g, c)}
    for k in (5, 4):
        all_orders[k - 1] = shorter(all_orders[k][0], k)
    out = dict(small)
    for k in (3, 4, 5):
        out |= tables(k, *all_orders[k], d[k], lambda s, k=k: np.exp(find(out[k - 1, False], s)[1]))
    return out


EMPTY = {(k, ctx): (np.zeros(0, np.int64), np.zeros(0)) for k in range(1, ORDER + 1) for ctx in (False, True)}


def find(table, keys):
    at = np.minimum(np.searchsorted(table[0], keys), max(len(table[0]) - 1, 0))
    hit = table[0][at] == keys if len(table[0]) else np.zeros(len(keys), bool)
    return hit, (table[1][at] if len(table[0]) else np.zeros(len(keys)))


def resolve(keys: np.ndarray, at: dict) -> np.ndarray:
    """Log probabilities of n-grams."""
    out, todo = np.zeros(len(keys)), np.arange(len(keys))
    for k in range(ORDER, 0, -1):
        g = keys[todo] & mask(k)
        hit, p = find(at[k, False], g)
        out[todo[hit]] += p[hit]
        todo, g = todo[~hit], g[~hit]
        hit, p = find(at[k, True], g >> 8)
        out[todo] += np.where(hit, p, 0.0)
    out[todo] -= math.log(256)
    return out


def perplexities(blocks: DataFrame, model: DataFrame, shards: np.ndarray, n: int) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity) of every document of the blocks."""
    few, bigrams = small_counts(model)
    bases = {f: base_tables(x, few.get(f, {})) for f, x in bigrams.items()}
    use = [1 - f if len(bases) == 2 else next(iter(bases), 0) for f in (0, 1)]
    parts = -(-blocks.select("block").count() // (REQUESTS * n)) or 1

    def ask(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = pa.Table.from_batches([b.slice(i, 1)])
                fold, block = use[row.column("fold")[0].as_py()], row.column("block")[0].as_py()
                g, _ = distinct(unpack(row))
                of = shards[fold][pair(g)]
                asked = [(int(s), g[of == s]) for s in np.unique(of)]
                data = [coded(x, x[:0]) for _, x in asked]
                yield pa.RecordBatch.from_arrays([pa.array([fold] * len(asked), pa.int32()), pa.array([s for s, _ in asked], pa.int32()), pa.array([part_of(block, parts)] * len(asked), pa.int32()), pa.array([block] * len(asked), pa.int64()), pa.array(data, pa.binary())], ["fold", "shard", "part", "block", "data"])

    asked = blocks.select("block", "fold", "sizes", "data").mapInArrow(ask, "fold int, shard int, part int, block long, data binary")
    entries = model.select("fold", "shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "data")

    def answer(left, right):
        got, at = [], EMPTY
        if left.num_rows:
            fold = left.column("fold")[0].as_py()
            if fold in bases:
                at = shard_tables(right.column("data").to_pylist(), *bases[fold])
        for data in left.column("data").to_pylist():
            g = np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.int64))
            got.append(resolve(g, at).astype(np.float32).tobytes())
        return pa.table({"block": pa.array(left.column("block").to_pylist(), pa.int64()), "shard": pa.array(left.column("shard").to_pylist(), pa.int32()), "data": pa.array(got, pa.binary())})

    key = ["fold", "shard", "part"]
    answers = asked.groupBy(*key).cogroup(entries.groupBy(*key)).applyInArrow(answer, "block long, shard int, data binary")
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def score(left, right):
        texts = unpack(left)
        g, _ = distinct(texts)
        of = shards[use[left.column("fold")[0].as_py()]][pair(g)]
        p = np.zeros(len(g), np.float32)
        for s, data in zip(right.column("shard").to_pylist(), right.column("data")):
            p[of == s] = np.frombuffer(data.as_py(), dtype=np.float32)
        logp, size = np.zeros(len(texts)), np.array(list(map(len, texts)), dtype=np.int64)
        for held, owners in gathered(texts):
            keys, starts = running(held)
            np.add.at(logp, owners, np.add.reduceat(p[np.searchsorted(g, keys)].astype(np.float64), starts))
        per = np.exp(-logp / np.maximum(size, 1))
        flat = lambda c: left.column(c).combine_chunks().flatten()
        return pa.table({"doc_id": flat("ids"), "lang": flat("langs"), "n_bytes": size, "perplexity": pa.array(per, mask=size == 0)})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"doc_id {kind}, lang string, n_bytes long, perplexity double")


def thresholds(scored: DataFrame, share: float, step: float = 0.001) -> DataFrame:
    """(lang, threshold): per language the perplexity that a ``share`` of the trusted documents stay
    within, from exact counts in bins of ``step`` of its logarithm."""
    bins = scored.where("perplexity is not null").groupBy("lang", F.ceil(F.log("perplexity") / step).alias("bin")).agg(F.sum(F.col("trusted").cast("long")).alias("t"), F.count("*").alias("n"))
    by = Window.partitionBy("lang")
    n = F.when(F.sum("t").over(by) > 0, F.col("t")).otherwise(F.col("n"))
    reach = bins.select("lang", "bin", n.alias("n")).select("lang", "bin", F.sum("n").over(by.orderBy("bin")).alias("upto"), F.sum("n").over(by).alias("all"))
    return reach.where(F.col("upto") >= F.col("all") * share).groupBy("lang").agg(F.exp(F.min("bin") * step).alias("threshold"))


def classify(docs: DataFrame, trusted: DataFrame, share: float = 0.99, bound: int = SHARD) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, threshold, kept) of every row of docs."""
    blocks, remove = stored(pack(docs))
    ids = trusted.where("doc_id is not null").select(F.col("doc_id").alias("__t")).distinct()
    scored = checkpoint(perplexities(blocks, *counts(blocks, trusted, bound)))
    remove()
    marked = scored.join(ids.hint("merge"), F.col("doc_id") == F.col("__t"), "left").select(*scored.columns, F.col("__t").isNotNull().alias("trusted"))
    limit = thresholds(marked, share).withColumnRenamed("lang", "__lang")
    out = scored.join(limit, scored["lang"].eqNullSafe(F.col("__lang")), "left")
    return out.select(*scored.columns, "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))
