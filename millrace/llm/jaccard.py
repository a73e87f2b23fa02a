"""Exact Jaccard join of word n-gram sets, by components, that skips through the relations of similar sets.

Sets are prefixes of an index: tokens ordered from rare to common, of which only the first few can hold the
first token that two linked sets share. Two relations save work:

* Between index entries: long lists are cut into blocks of sets of like size, and the position of a token
  in a set says how large a linked set can be, so that a set meets only the blocks that its position
  leaves open.
* Between answers: each set is first compared with the nearest of those that lead its lists. The answers
  of sets found alike are derived from those of their class, which only lacks links to other classes, so
  that pairs within a class are never made, and of pairs between classes each class's nearest are tried first.

Pairs are bounded by sizes, positions and parity bitmaps (bits in which these differ are at most the
tokens in which the sets do) before their whole texts are compared. The bitmaps of large sets grow with them,
as a fixed number of bits tells nothing of sets that may differ in more tokens.

Defined results: null and wordless texts have no shingles and are their own class; a null doc_id takes the
smallest id it reaches (null if there is none); repeated rows each get their row; other columns are ignored;
an empty table gives no rows. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from millrace.llm.common import checkpoint, connected_components, slices, written
from millrace.llm.simhash import SEED, shingle_hashes

#: Counters that order tokens by how common they are (a power of 2): a bound that no corpus moves.
COUNTERS, CHUNK = 1 << 22, 1 << 12
#: Entries of a list from which on it is cut into blocks, entries of a block that meet in one task, and the ratio of sizes in a block.
HOT, SALT, STEP = 64, 512, 1.02
#: Bits of the filter on documents whose texts are compared (a bound that no corpus moves).
FILTER = 1 << 20
BITS = ["b0", "b1", "b2", "b3"]
#: Tokens from which on a set has a wide bitmap too.
WIDE = 512


def token_set(text: bytes | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's n-word shingles."""
    parts = [np.unique(x) for x in shingle_hashes(text, n)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def set_id(tokens: np.ndarray) -> int:
    return int(np.uint64(xxh64_intdigest(tokens.tobytes(), SEED)).view(np.int64))


def wide_bitmap(tokens: np.ndarray) -> bytes | None:
    """The parity bitmap of a set of more than WIDE tokens: a power of 2 of bits, half to all of its size."""
    if len(tokens) <= WIDE:
        return None
    bits = 1 << (len(tokens).bit_length() - 1)
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def wide_apart(x: bytes, y: bytes) -> int:
    """In how many bits two wide bitmaps differ, the longer one folded to the size of the other."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def each_set(batch_column, n: int):
    for part in slices(batch_column.cast(pa.binary())):
        for t in part:
            yield token_set(t.as_py(), n)


def commonness(docs: DataFrame, n: int) -> np.ndarray:
    """A rank of commonness for each counter that tokens are dealt to, from counts over all documents."""

    def run(batches):
        total = np.zeros(COUNTERS, dtype=np.int32)
        for b in batches:
            for x in each_set(b.column(0), n):
                np.add.at(total, (x % COUNTERS).astype(np.int64), 1)
        for at in range(0, COUNTERS, CHUNK):
            part = total[at : at + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at // CHUNK], pa.int32()), pa.ListArray.from_arrays(pa.array([0, CHUNK], pa.int32()), pa.array(part))], ["chunk", "counts"])

    parts = docs.select("text").mapInArrow(run, "chunk int, counts array<int>").repartition("chunk")
    sums = parts.select("chunk", F.posexplode("counts").alias("pos", "c")).groupBy("chunk", "pos").agg(F.sum("c").alias("c"))
    rank = F.round(F.log2(F.col("c") + 1) * 8).cast("smallint")
    whole = sums.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("pos", rank.alias("r")))).alias("x")).select("chunk", F.transform("x", lambda x: x["r"]).alias("r"))
    out, got = np.zeros(COUNTERS, dtype=np.int16), whole.toArrow()
    for i, chunk in enumerate(got.column("chunk").to_pylist()):
        out[chunk * CHUNK : (chunk + 1) * CHUNK] = got.column("r")[i].values.to_numpy()
    return out


def least_shared(a, b, percent: int):
    """The least intersection of linked sets of a and b tokens."""
    return F.ceil(((a + b) * percent) / (100 + percent))


def described(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, sid, size, b0.., wide, prefix): of each text's set its id, size, parity bitmaps and rarest
    tokens, in order, as many as can hold the first one that it shares with a linked set."""
    sent = docs.sparkSession.sparkContext.broadcast(commonness(docs, n))

    def run(batches):
        rank = sent.value
        for b in batches:
            sids, sizes, bits, wide, prefixes = [], [], [], [], []
            for x in each_set(b.column(1), n):
                bins = np.bincount((x >> np.uint64(56)).astype(np.int64), minlength=256) & 1
                bits.append(np.packbits(bins.astype(np.uint8), bitorder="little").view(np.int64))
                wide.append(wide_bitmap(x))
                order = np.lexsort((x, rank[(x % COUNTERS).astype(np.int64)]))
                most = len(x) - -(-percent * len(x) // 100) + 1 if len(x) else 0
                prefixes.append(x[order[:most]].view(np.int64))
                sids.append(set_id(x))
                sizes.append(len(x))
            at = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            held = np.array(bits, dtype=np.int64).reshape(-1, 4)
            arrays = [b.column(0), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(held[:, i]) for i in range(4)), pa.array(wide, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "sid", "size", *BITS, "wide", "prefix"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, sid long, size long, {', '.join(f'{b} long' for b in BITS)}, wide binary, prefix array<long>")


def reach(x: str, y: str, percent: int):
    """Whether sizes and positions of two entries (columns with these prefixes) allow a link."""
    left = F.least(F.col(f"{x}size") - F.col(f"{x}pos"), F.col(f"{y}size") - F.col(f"{y}pos"))
    return left >= least_shared(F.col(f"{x}size"), F.col(f"{y}size"), percent)


def apart(x: str, y: str):
    """In how many bits the bitmaps of two sets differ."""
    differ = [F.bit_count(F.col(f"{x}{b}").bitwiseXOR(F.col(f"{y}{b}"))) for b in BITS]
    return differ[0] + differ[1] + differ[2] + differ[3]


def near(x: str, y: str, percent: int):
    """Whether the bitmaps of two sets allow a link."""
    a, b = F.col(f"{x}size"), F.col(f"{y}size")
    return apart(x, y) <= a + b - 2 * least_shared(a, b, percent)


def named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}{c}") for c in df.columns))


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ..) that wide bitmaps, where both sets have one, allow to be linked."""
    wide = sets.where("wide is not null").select("sid", "size", "wide")
    on = lambda x, key: F.col(f"{x}sid") == F.col(key)
    both = pairs.join(named(wide, "x_").hint("merge"), on("x_", "a"), "left").join(named(wide, "y_").hint("merge"), on("y_", "b"), "left")

    def run(batches):
        for batch in batches:
            n = len(pairs_columns)
            keep = []
            for sx, wx, sy, wy in zip(*(batch.column(n + i).to_pylist() for i in range(4))):
                keep.append(wx is None or wy is None or wide_apart(wx, wy) <= sx + sy - 2 * -(-percent * (sx + sy) // (100 + percent)))
            yield pa.RecordBatch.from_arrays(batch.columns[:n], pairs_columns).filter(pa.array(keep, pa.bool_()))

    pairs_columns = pairs.columns
    return both.select(*pairs_columns, "x_size", "x_wide", "y_size", "y_wide").mapInArrow(run, pairs.schema)


def linked(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids whose whole texts are linked; texts(sid, text)."""
    t = texts.select(F.col("sid").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(texts.select(F.col("sid").alias("a"), F.col("text").alias("ta")).hint("merge"), "a").join(t.hint("merge"), "b").select("a", "b", "ta", "tb")

    def run(batches):
        of, held = None, None  # rows come by b: its set is that of the row before, mostly
        for batch in batches:
            a, b, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            left, right = batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())
            for i in range(batch.num_rows):
                if b[i] != of:
                    of, held = b[i], token_set(right[i].as_py(), n)
                x = token_set(left[i].as_py(), n)
                shared = len(np.intersect1d(x, held, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(held) - shared))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in ([p for p, k in zip(a, keep) if k], [p for p, k in zip(b, keep) if k])], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def with_class(df: DataFrame, roots: DataFrame, key: str, name: str) -> DataFrame:
    found = df.join(roots.select(F.col("v").alias(key), F.col("root").alias("__root")).hint("merge"), key, "left")
    return found.withColumn(name, F.coalesce("__root", F.col(key))).drop("__root")


def crossing(entries: DataFrame, bits: DataFrame, percent: int, hot: int = HOT) -> DataFrame:
    """(a, b, apart): possible pairs of sets of different classes, from entries(token, sid, size, pos, class) and
    bits(sid, b0..).

    One side of such a pair isn't of the list's largest class, so that the entries of that class never meet
    each other. In lists of more than ``hot`` entries a set meets blocks of like sizes, dealt to tasks
    of SALT entries or fewer of an average block.
    """
    kinds = entries.groupBy("token", "class").agg(F.count("*").alias("c"))
    lists = kinds.groupBy("token").agg(F.max_by("class", F.struct("c", "class")).alias("main"), F.sum("c").alias("n"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    e = entries.join(lists.hint("merge"), "token").withColumn("other", F.col("class") != F.col("main")).drop("main")
    e = written(e.join(bits.hint("merge"), "sid"))
    block = lambda size: F.floor(F.log(size) / math.log(STEP)).cast("int")
    salts = F.when(F.col("n") > hot, F.floor(F.col("n") / SALT)).otherwise(0).cast("int")
    low, high = F.ceil(F.col("size") * percent / 100), F.least(F.col("size"), F.floor((F.col("size") * 100 - F.col("pos") * (100 + percent)) / percent))
    probes = e.where(high >= low).withColumn("block", F.explode(F.when(F.col("n") > hot, F.sequence(block(low), block(high))).otherwise(F.array(F.lit(-1)))))
    probes = named(probes.withColumn("salt", F.explode(F.sequence(F.lit(0), salts))), "x_")
    index = e.where(F.col("pos") <= F.col("size") - least_shared(F.col("size"), F.col("size"), percent))
    index = index.withColumn("block", F.when(F.col("n") > hot, block(F.col("size"))).otherwise(-1)).withColumn("salt", F.pmod(F.xxhash64("sid"), salts + 1).cast("int"))
    index = named(index, "y_")
    smaller = (F.col("y_size") < F.col("x_size")) | ((F.col("y_size") == F.col("x_size")) & (F.col("y_sid") < F.col("x_sid")))
    on = (F.col("x_token") == F.col("y_token")) & (F.col("x_block") == F.col("y_block")) & (F.col("x_salt") == F.col("y_salt")) & smaller & (F.col("x_class") != F.col("y_class")) & reach("x_", "y_", percent) & near("x_", "y_", percent)
    met = [probes.join(index.where("y_other").hint("merge"), on), probes.where("x_other").join(index.where("not y_other").hint("merge"), on)]
    cut = [m.select(F.col("x_sid").alias("a"), F.col("y_sid").alias("b"), apart("x_", "y_").alias("apart")) for m in met]
    return cut[0].unionByName(cut[1]).groupBy("a", "b").agg(F.first("apart").alias("apart"))


def fetched(docs: DataFrame, sets: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(sid, text) of the wanted(sid): a text for each. Documents whose id falls on no bit of the wanted ones'
    (FILTER bits, whatever the corpus) are passed over before their texts are read."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER)).cast("int")
    on = np.zeros(FILTER, dtype=bool)
    on[[r.bit for r in sets.select("sid", "least").join(wanted.hint("merge"), "sid", "left_semi").select(bit("least").alias("bit")).distinct().collect()]] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(on))

    def identified(batches):
        on = np.unpackbits(sent.value).astype(bool)
        for b in batches:
            texts = b.column(0).filter(pa.array(on[b.column(1).to_numpy()]))
            yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in each_set(texts, n)], pa.int64()), texts], ["sid", "text"])

    found = docs.select("text", bit("doc_id")).mapInArrow(identified, "sid long, text string").join(wanted.hint("merge"), "sid", "left_semi")
    return written(found.groupBy("sid").agg(F.first("text").alias("text")))


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()


def set_classes(sets: DataFrame, docs: DataFrame, n: int, percent: int, rounds: int = 3) -> DataFrame:
    """(v, root) of the distinct sets(sid, least, size, b0.., wide, prefix) that are linked with others."""
    entries = sets.select("sid", "size", F.posexplode("prefix").alias("pos", "token"))
    lists = entries.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    entries = entries.join(lists.select("token").hint("merge"), "token")
    entries, bits = written(entries), sets.select("sid", *BITS)

    # The first answers: each set against the nearest of those that lead its lists. A list is led by the set
    # with the fewest rarer tokens, as the origin of near copies has.
    leads = entries.groupBy("token").agg(F.min(F.struct("pos", "sid", "size")).alias("y")).select("token", *(F.col(f"y.{c}").alias(f"y_{c}") for c in ("sid", "size", "pos")))
    led = named(entries, "x_").join(leads.hint("merge"), F.col("x_token") == F.col("token")).where((F.col("x_sid") != F.col("y_sid")) & reach("x_", "y_", percent))
    led = led.select("x_sid", "y_sid", "x_size", "y_size").distinct()
    led = led.join(named(bits, "x_").hint("merge"), "x_sid").join(named(bits, "y_").hint("merge"), "y_sid").where(near("x_", "y_", percent))
    best = checkpoint(led.groupBy(F.col("x_sid").alias("a")).agg(F.min_by("y_sid", F.struct(apart("x_", "y_"), "y_sid")).alias("b")))
    hopeful = checkpoint(likely(best, sets, percent))
    edges = checkpoint(linked(hopeful, fetched(docs, sets, ends(hopeful), n), n, percent))
    roots = checkpoint(connected_components(edges))

    # What links classes: each class's nearest pairs are tried first, then all that still lie between two classes.
    met = crossing(with_class(entries, roots, "sid", "class"), bits, percent).join(best.hint("merge"), ["a", "b"], "left_anti")
    left = checkpoint(likely(met, sets, percent))
    texts = None
    for nth in range(rounds):
        between = with_class(with_class(left, roots, "a", "ca"), roots, "b", "cb").where("ca <> cb")
        if nth < rounds - 1:
            sides = between.select(F.col("ca").alias("c"), "apart", "a", "b").unionByName(between.select(F.col("cb").alias("c"), "apart", "a", "b"))
            tried = sides.groupBy("c").agg(F.min(F.struct("apart", "a", "b")).alias("s")).select("s.a", "s.b").distinct()
        else:
            tried = between.select("a", "b")
        tried = checkpoint(tried)
        if tried.isEmpty():
            break
        texts = texts or fetched(docs, sets, ends(left), n)
        edges = checkpoint(edges.unionByName(linked(tried, texts, n, percent)))
        roots = checkpoint(connected_components(edges))
        left = left.join(tried.hint("merge"), ["a", "b"], "left_anti")
    return roots


def classes(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs: component_id is the smallest doc_id that links lead to."""
    rows = written(described(docs, n, percent))
    # What describes a set follows from its id, so that copies become one row before anything is shuffled.
    sets = written(rows.where("size > 0").groupBy("sid").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("size", *BITS, "wide", "prefix"))))
    roots = set_classes(sets, docs, n, percent)
    of = with_class(sets.select("sid", "least"), roots, "sid", "root")
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = of.join(least.hint("merge"), "root").select("sid", "component_id")
    found = rows.select("doc_id", "sid", "size").join(of.hint("merge"), "sid", "left")
    return found.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
