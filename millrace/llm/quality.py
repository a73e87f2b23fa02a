"""Quality rules: word statistics, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hash buckets of words and word pairs: one of trusted
documents, one of the whole corpus; a document's sum is divided by its number of n-grams and held
against a fixed threshold, so every document has the same verdict in every run.

Defined results: null texts have no words; a document without words scores 0 and fails the base rules;
without any trusted document every score is 0; repeated rows count and are returned each; a null
doc_id is never trusted; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import let, words

#: Buckets of the hashed n-grams, as many for single words as for pairs together.
BUCKETS = 10_000
#: Added to each bucket's count, per million n-grams of the table.
SMOOTH = 0.5
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\v\f\r"


def _next(a, by: int):
    """Hashes of each element of a with that ``by`` places after it."""
    n = F.greatest(F.size(a) - by, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(a, by + 1, n), lambda x, y: F.xxhash64(x, y))


def _grams(hashes, pairs=None):
    """Buckets of the words and of the pairs of neighbours."""
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    return F.concat(F.transform(hashes, bucket), F.transform(_next(hashes, 1) if pairs is None else pairs, bucket))


def _hashes(text):
    return F.transform(words(text), lambda w: F.xxhash64(w))


def ratios(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row with llr, an array of BUCKETS log-likelihood ratios: counts of all n-grams of all
    documents, of which ``trusted`` (doc_id) names those of the target. Counts are pre-aggregated in
    each task to a row for each bucket."""
    ids = trusted.where("doc_id is not null").select(F.col("doc_id").alias("__t")).distinct()
    # Trusted ids grow with the documents: a sort-merge join at every size.
    marked = docs.select("doc_id", "text").join(ids.hint("merge"), F.col("doc_id") == F.col("__t"), "left")
    flat = marked.select(F.col("__t").isNotNull().cast("long").alias("t"), F.explode(let(_hashes(F.col("text")), lambda h: _grams(h))).alias("bucket"))
    n = flat.groupBy("bucket").agg(F.sum("t").alias("t"), F.count("*").alias("r"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(n, "bucket", "left").na.fill(0)
    table = every.agg(F.array_sort(F.collect_list(F.struct("bucket", "t", "r"))).alias("x"), F.sum("t").alias("t"), F.sum("r").alias("r"))
    term = lambda x, k: F.log((x[k] + SMOOTH) / (F.col(k) + SMOOTH * BUCKETS))
    return table.select(F.transform("x", lambda x: F.when(F.col("t") == 0, F.lit(0.0)).otherwise(term(x, "t") - term(x, "r"))).alias("llr"))


def _repeated(pairs):
    """Words inside windows of eight words that the text holds twice or more, the first included.

    A window's hash is built from those of its halves. Equal windows stand side by side once (hash,
    position) pairs are sorted; a text whose window hashes are all different is done before that.
    """
    size = 8
    w = let(_next(pairs, 2), lambda four: _next(four, 4))

    def count(w):
        pairs = F.array_sort(F.transform(w, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        same = lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        at = F.array_sort(F.transform(let(pairs, same), lambda x: x["p"]))
        cover = lambda a: F.aggregate(F.zip_with(a, F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda p, q: F.least(F.coalesce(q - p, F.lit(size)), F.lit(size))), F.lit(0).cast("long"), lambda s, x: s + x)
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(at, cover))

    return F.when(F.size(pairs) < size, F.lit(0).cast("long")).otherwise(let(w, count))


def rules(docs: DataFrame, llr: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept)."""
    docs = docs.select("doc_id", "text", llr.scalar().alias("llr"))
    text = F.coalesce(F.col("text"), F.lit(""))
    full = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    held = F.length(F.translate(text, SPACE, ""))

    def measure(h, pairs):
        grams = let(_grams(h, pairs), lambda g: F.aggregate(g, F.lit(0.0), lambda s, b: s + F.get(F.col("llr"), b)) / F.size(g))
        return F.struct(F.size(h).cast("long").alias("n_words"), _repeated(pairs).alias("n_repeat_words"), F.when(F.size(h) > 0, grams).otherwise(F.lit(0.0)).alias("score"))

    d = docs.select(
        "doc_id",
        let(_hashes(F.col("text")), lambda h: let(_next(h, 1), lambda pairs: measure(h, pairs))).alias("m"),
        held.cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    d = d.select("doc_id", "m.n_words", "word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words", "m.score")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    d = d.withColumn("base_failed", failed)
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
