"""Mixing sources to target weights.

The words of each source are laid end to end (documents in the order of a hash bucket, then doc_id)
and packed into blocks of BLOCK words. The targets are quotas of blocks; every slot of the mix draws
its source at random with the quotas as probabilities, which makes the counts of each output shard
(SHARD slots) multinomial. The n-th slot of a source takes the block at index n of the source's
pseudorandom permutation, and blocks are joined to slots by index. Draws beyond a source's quota are
dealt, in slot order, to sources that drew too few, so each source takes its target to the word.

Defined results: null texts have no words; a null source is a source, and comes last; repeated rows are
documents of their own; a null doc_id sorts first; other columns are ignored; an empty table, or one
without words, gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, checkpoint, words

BLOCK = 128
#: Slots of an output shard, about 8 million words.
SHARD = 65_536
#: Hash buckets of a source, so that no window has to order a whole source: one for so many rows of all
#: documents, 1,024 at least. They are dealt by doc_id and text, so that ids that repeat don't meet in one.
BUCKET_ROWS, BUCKETS = 16_384, 1024
WEIGHTS = (5, 2, 1)
ROUNDS = 24
SEED = 20


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """sources(source, source_size) with src (rank by code point, null last), weight and target.

    Weights repeat in rank order and share ``share`` of all words; a target stops at ``most`` times the
    source's size and the excess goes to the others by weight. With sources ordered by size over
    weight, the level that those not stopped share is the largest of (total - stopped before) / (weights
    from here on).
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    s = sources.withColumn("src", rank.cast("long"))
    s = s.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("src") % len(weights) + 1).cast("int")))
    by, whole = Window.orderBy(F.col("source_size") / F.col("weight"), "src"), Window.partitionBy()
    before = F.coalesce(F.sum("source_size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.lit(most)
    after = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(whole) * F.lit(share) - before) / after)
    return s.withColumn("target", F.least(F.col("source_size") * F.lit(most), F.max("level").over(whole) * F.col("weight"))).drop("level")


def _permuted(x, n, src, back: bool = False):
    """x under a bijection of 0..n-1 drawn for src: a swap-or-not shuffle (Hoang et al. 2012)."""
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def swap(x, r):
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), src, r), n) - x, n)
        return F.when(F.pmod(F.xxhash64(F.lit(SEED + 1), src, r, F.greatest(x, other)), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(rounds, x, swap)


def quotas(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """sources with want (words to take), n_blocks, last (length of the last block), j_last (index of
    the last block in the permutation), n_slots, first (number of the source's first quota) and total
    (slots of all sources); sources that give nothing are left out."""
    s = sources.withColumn("want", F.floor(F.col("target") + 0.5)).where("want > 0")
    s = s.withColumn("n_blocks", F.ceil(F.col("source_size") / F.lit(block)))
    s = s.withColumn("last", F.col("source_size") - (F.col("n_blocks") - 1) * block)
    s = s.withColumn("j_last", _permuted(F.col("n_blocks") - 1, F.col("n_blocks"), F.col("src"), back=True))
    short = F.lit(block) - F.col("last")
    need = [F.ceil((F.col("want") + short * k) / F.lit(block)) for k in range(3)]
    slots = F.when(need[0] <= F.col("j_last"), need[0]).when(need[1] <= F.col("j_last") + F.col("n_blocks"), need[1]).otherwise(need[2])
    s = s.withColumn("n_slots", F.least(F.greatest(slots, F.lit(1)), 2 * F.col("n_blocks")))
    upto = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    return s.select("*", F.coalesce(F.sum("n_slots").over(upto), F.lit(0)).alias("first"), F.sum("n_slots").over(whole).alias("total"), F.count("*").over(whole).alias("k"))


def slots(quota: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The mix: (shard, slot, src, source, block, take), take being the words used of the block (all, but for
    each source's last slot)."""
    some = 1 << 16
    part = quota.select("first", "n_slots", "total", "k", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_slots") - 1) / some))).alias("c")).repartition("first", "c")
    line = part.select("total", "k", F.explode(F.sequence(F.col("first") + F.col("c") * some, F.col("first") + F.least(F.col("n_slots"), (F.col("c") + 1) * some) - 1)).alias("slot"))
    # A draw is a point on the line of quotas; sources lie in as many cells of it as they touch.
    cell = F.ceil(F.col("total") / (4096 + 2 * F.col("k")))
    point = F.pmod(F.xxhash64(F.lit(SEED + 2), F.col("slot")), F.col("total"))
    drawn = line.select("slot", point.alias("point"), F.floor(point / cell).alias("cell"))
    held = quota.select("src", "first", "n_slots", F.explode(F.sequence(F.floor(F.col("first") / cell), F.floor((F.col("first") + F.col("n_slots") - 1) / cell))).alias("cell"))
    # Joins here are sort-merge at every size: slots grow with the words, and a plan that explodes few
    # rows into many looks small enough to broadcast.
    drawn = drawn.join(held.hint("merge"), "cell").where("point >= first and point < first + n_slots").select("slot", "src", "n_slots", F.floor(F.col("slot") / shard).alias("shard"))
    within = Window.partitionBy("shard", "src").orderBy("slot")
    drawn = checkpoint(drawn.withColumn("k", F.row_number().over(within) - 1))
    counts = checkpoint(drawn.groupBy("src", "shard").agg(F.count("*").alias("n"), F.first("n_slots").alias("n_slots")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = counts.select("src", "shard", before.alias("before"))
    drawn = drawn.join(begins.hint("merge"), ["src", "shard"]).withColumn("j", F.col("before") + F.col("k"))
    fits = drawn.where("j < n_slots").select("shard", "slot", "src", "j")
    over = drawn.where("j >= n_slots").select("shard", "slot")
    # The surplus by (shard, slot) meets what is missing by (source, index), rank by rank.
    extra = counts.select("src", "shard", "n", (F.col("n_slots") - before).alias("room")).select("shard", F.greatest(F.col("n") - F.greatest(F.col("room"), F.lit(0)), F.lit(0)).alias("n"))
    extra = extra.groupBy("shard").agg(F.sum("n").alias("n")).where("n > 0")
    extra = extra.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    over = over.withColumn("k", F.row_number().over(Window.partitionBy("shard").orderBy("slot")) - 1).join(extra.hint("merge"), "shard").select("shard", "slot", (F.col("base") + F.col("k")).alias("rank"))
    got = counts.groupBy("src").agg(F.sum("n").alias("got"))
    less = quota.select("src", "n_slots").join(got, "src", "left").select("src", "n_slots", F.coalesce("got", F.lit(0)).alias("got")).where("got < n_slots")
    less = less.withColumn("base", F.coalesce(F.sum(F.col("n_slots") - F.col("got")).over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    less = less.select("src", "base", "got", F.explode(F.sequence(F.col("got"), F.col("n_slots") - 1)).alias("j")).select("src", "j", (F.col("base") + F.col("j") - F.col("got")).alias("rank"))
    all_slots = fits.unionByName(over.join(less.hint("merge"), "rank").select("shard", "slot", "src", "j"))
    q = quota.select("src", "source", "n_blocks", "last", "j_last", "want")
    s = all_slots.join(q.hint("merge"), "src")
    s = s.withColumn("block", _permuted(F.col("j") % F.col("n_blocks"), F.col("n_blocks"), F.col("src")))
    short = F.lit(block) - F.col("last")
    done = F.col("j") * block - short * ((F.col("j") > F.col("j_last")).cast("long") + (F.col("j") > F.col("j_last") + F.col("n_blocks")).cast("long"))
    size = F.when(F.col("block") == F.col("n_blocks") - 1, F.col("last")).otherwise(F.lit(block))
    return s.select("shard", "slot", "src", "source", "block", F.least(size, F.col("want") - done).alias("take")).where("take > 0")


def lay_out(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """sources with targets, and docs (columns ``keep``) with their source's src, source_size and target,
    their size, bucket, rn (rank in the bucket) and start (first word's index in the source)."""
    cols = list(dict.fromkeys(["doc_id", *keep]))
    buckets = max(BUCKETS, -(-docs.count() // BUCKET_ROWS))
    d = docs.select(*(F.col(c).alias(f"__{c}") for c in cols), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("th"))
    # A key that is never null: the window, and the join after it, then share one exchange of the texts.
    d = d.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))).withColumn("bucket", F.pmod(F.xxhash64("__doc_id", "th"), F.lit(buckets)))
    parts = checkpoint(d.groupBy("source", "key", "bucket").agg(F.sum("size").alias("n")))
    sources = checkpoint(targets(parts.groupBy("source", "key").agg(F.sum("n").alias("source_size"))))
    at = parts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = at.select("key", "bucket", "base").join(sources.select("key", "src", "source_size", "target").hint("merge"), "key")
    by = Window.partitionBy("key", "bucket").orderBy("__doc_id", "th", "size")
    d = d.withColumn("rn", F.row_number().over(by)).withColumn("upto", F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.join(at.hint("merge"), ["key", "bucket"])
    return sources, d.select(*(F.col(f"__{c}").alias(c) for c in keep), "src", "source_size", "target", "size", "bucket", "rn", (F.col("base") + F.col("upto") - F.col("size")).alias("start"))


def pieces(laid: DataFrame, block: int = BLOCK) -> DataFrame:
    """laid with a row for each block that a document lies in: lo and hi in the block; from, in the
    document. Documents without words have one row of nulls."""
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    p = laid.select("*", F.explode_outer(blocks).alias("block"))
    some = F.col("block").isNotNull()  # greatest and least pass nulls over
    lo = F.when(some, F.greatest(F.col("start") - F.col("block") * block, F.lit(0)))
    hi = F.when(some, F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block)))
    return p.select("*", lo.alias("lo"), hi.alias("hi"), (F.col("block") * block + lo - F.col("start")).alias("from"))


def taken(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row: words that the mix takes of it."""
    sources, laid = lay_out(docs, ["doc_id"])
    mix = slots(checkpoint(quotas(sources))).select("src", "block", "take")
    row = ["doc_id", "size", "source_size", "target", "src", "bucket", "rn"]
    used = pieces(laid).join(mix.hint("merge"), ["src", "block"], "left")
    n = F.greatest(F.least(F.col("hi"), F.coalesce("take", F.lit(0))) - F.col("lo"), F.lit(0))
    return used.groupBy(*row).agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("taken")).select(*row[:4], "taken")


def mix(docs: DataFrame) -> DataFrame:
    """The mixed blocks: (shard, slot, source, n_words, doc_ids, text), words joined by one space; blocks
    hold the words of the documents that lie in them, in order."""
    sources, laid = lay_out(docs, ["doc_id", "text"])
    p = pieces(laid.withColumn("w", words(F.col("text"))).drop("text")).where("block is not null")
    # Pieces travel as strings, a third the size of arrays of words; lo orders them, BLOCK a block at most.
    own = F.array_join(F.slice("w", F.col("from").cast("int") + 1, (F.col("hi") - F.col("lo")).cast("int")), " ")
    whole = p.select("src", "block", F.struct("lo", "hi", "doc_id", own.alias("text")).alias("p"))
    whole = whole.groupBy("src", "block").agg(F.array_sort(F.collect_list("p")).alias("p"))
    m = slots(checkpoint(quotas(sources))).hint("merge").join(whole, ["src", "block"])
    used = F.filter("p", lambda x: x["lo"] < F.col("take"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), " ")
    cut = F.when(F.element_at("p", -1)["hi"] <= F.col("take"), text).otherwise(F.array_join(F.slice(F.split(text, " "), F.lit(1), F.col("take").cast("int")), " "))
    return m.select("shard", "slot", "source", F.col("take").alias("n_words"), F.transform(used, lambda x: x["doc_id"]).alias("doc_ids"), cut.alias("text"))
