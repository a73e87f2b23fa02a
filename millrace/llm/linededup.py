"""Line dedup by overlapping windows of three lines.

Windows run over the lines of a text that hold more than white space, compared without the white
space at their ends. Of the windows with equal lines, over all documents, the one that is first by
(doc_id, text hash, position) stays; the lines that later ones cover are merged into ranges and
removed, with the blank lines inside a range. All else stays as it is.

Defined results: null texts stay null; texts of fewer than three lines have no window; rows with equal
doc_id and text are one document and are treated alike; null ids come first; documents whose lines all
go keep an empty text; extra columns are carried along; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import let

#: White space that doesn't count at the ends of a line.
BLANK = " \t\v\f\r"


def _lines():
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)


def _full(lines):
    """(index, line without outer white space) of the lines that hold anything else."""
    at = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(BLANK)).alias("key")))
    return F.filter(at, lambda x: x["key"] != "")


def repeats(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, th, at): for each document the sorted positions, counted in full lines, at which a
    window begins that occurs earlier in the corpus. Only hashes of windows are shuffled; equal
    windows are pre-aggregated, and the join back is one that Spark can split by key."""
    keys = F.transform(_full(_lines()), lambda x: F.xxhash64(x["key"]))
    windows = let(
        keys,
        lambda k: F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(k) - size, F.lit(0))),
            lambda p: F.struct(F.xxhash64(F.slice(k, p + 1, size)).alias("w1"), F.xxhash64(F.lit(1), F.reverse(F.slice(k, p + 1, size))).alias("w2"), p.alias("p"), F.size(k).alias("n")),
        ),
    )
    w = docs.select("doc_id", F.xxhash64("text").alias("th"), F.inline(windows)).where(F.col("n") >= size).drop("n")
    where = F.struct("doc_id", "th", "p")
    first = w.groupBy("w1", "w2").agg(F.min(where).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = w.join(first.hint("merge"), ["w1", "w2"]).where(~where.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("p")).alias("at"))


def _without(lines, full, at, size):
    """lines without the ranges that windows at the sorted positions ``at`` cover, and how many full lines go."""
    n = F.size(at)
    starts = F.filter(at, lambda p, k: (k == 0) | (p > F.get(at, k - 1) + size))
    ends = F.filter(at, lambda p, k: (k == n - 1) | (F.get(at, k + 1) > p + size))
    gone = F.zip_with(starts, ends, lambda a, b: F.struct(F.get(full, a)["i"].alias("lo"), (F.get(full, b + size - 1)["i"] + 1).alias("hi"), (b - a + size).alias("n")))

    def kept(g):
        parts = F.transform(F.sequence(F.lit(0), F.size(g)), lambda j: let(F.coalesce(F.get(g, j - 1)["hi"], F.lit(0)), lambda lo: F.slice(lines, lo + 1, F.coalesce(F.get(g, j)["lo"], F.size(lines)) - lo)))
        return F.struct(F.array_join(F.flatten(parts), "\n").alias("text"), F.aggregate(g, F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n"))

    return let(gone, kept)


def dedup(docs: DataFrame, size: int = 3, counts: bool = False) -> DataFrame:
    """docs with repeated windows removed from text (n_chars, where there is one, follows); with
    ``counts`` also n_lines (full lines before) and n_removed."""
    found = repeats(docs, size).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("at").alias("__at"))
    keyed = docs.withColumn("__h", F.xxhash64("text"))
    # What is found grows with the documents: a sort-merge join at every size.
    joined = keyed.join(found.hint("merge"), keyed["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")), "left")
    new = F.when(F.col("__at").isNotNull(), let(_lines(), lambda x: let(_full(x), lambda f: let(F.col("__at"), lambda a: _without(x, f, a, size)))))
    out = joined.withColumn("__new", new)
    cols = {"text": F.when(F.col("__new").isNull(), F.col("text")).otherwise(F.col("__new.text"))}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(F.col("__new").isNull(), F.col("n_chars")).otherwise(F.length("__new.text").cast(docs.schema["n_chars"].dataType))
    more = [F.size(_full(_lines())).cast("long").alias("n_lines"), F.coalesce("__new.n", F.lit(0).cast("long")).alias("n_removed")] if counts else []
    return out.select(*(cols.get(c, F.col(c)).alias(c) for c in docs.columns), *more)
