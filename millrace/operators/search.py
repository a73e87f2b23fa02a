"""Full-text search: boolean matching, BM25, TF-IDF, query relaxation and batches of queries.

An index is a table of postings, one row for each (row_id, term): f (occurrences weighed by column) and
size (tokens of the row). Terms are filtered before anything is aggregated, so that a table stored by
term is pruned; statistics of the corpus (rows, mean size, document frequencies) cover all of it.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.functions import analysis
from millrace.session import checkpoint

K1, B = 1.2, 0.75
#: Bytes of text whose postings are in one file of an index.
FILE_BYTES = 16 << 20


def tokenised(docs: DataFrame, row_id: str, columns, **how) -> DataFrame:
    """(row_id, t0, t1, ...): the tokens of each column."""
    return docs.select(F.col(row_id).alias("row_id"), *(analysis.tokens(c, **how).alias(f"t{i}") for i, c in enumerate(columns)))


def _size(columns):
    return reduce(lambda a, b: a + b, (F.size(f"t{i}") for i in range(len(columns))))


def postings(docs: DataFrame, row_id: str, columns: dict[str, float], **how) -> DataFrame:
    """(row_id, term, f, size) of all terms."""
    r = tokenised(docs, row_id, columns, **how)
    weighed = lambda t, w: F.transform(t, lambda x: F.struct(x.alias("term"), F.lit(float(w)).alias("w")))
    own = [weighed(f"t{i}", w) for i, w in enumerate(columns.values())]
    return r.select("row_id", _size(columns).alias("size"), F.explode(F.concat(*own)).alias("x")).groupBy("row_id", F.col("x.term").alias("term"), "size").agg(F.sum("x.w").alias("f"))


def frequencies(docs: DataFrame, row_id: str, columns: dict[str, float], terms: list[str], prefix: bool = False, **how) -> DataFrame:
    """(row_id, size, has, f) of every row: which of the terms it has, and each one's weighed occurrences, in
    the terms' order; prefix: a term stands for all words that start so. A row is one document, so nothing is
    shuffled."""
    r = tokenised(docs, row_id, columns, **how)

    def kept(t):
        if not prefix:
            return F.filter(t, lambda x: x.isin(list(terms)))
        return F.concat(*(F.transform(F.filter(t, lambda x: x.startswith(w)), lambda x: F.lit(w)) for w in terms))

    held = r.select("row_id", _size(columns).alias("size"), *(kept(f"t{i}").alias(f"k{i}") for i in range(len(columns))))
    f = [reduce(lambda a, b: a + b, (F.size(F.filter(f"k{i}", lambda x: x == t)) * float(w) for i, w in enumerate(columns.values()))) for t in terms]  # noqa: B023
    has = F.array_distinct(F.concat(*(F.col(f"k{i}") for i in range(len(columns)))))
    # A filter on what a generator makes isn't pushed below it, where it would tokenise every row once more.
    return held.select(F.stack(F.lit(1), "row_id", "size", has, F.array(*f)).alias("row_id", "size", "has", "f"))


def _measured(rows: DataFrame, terms: list[str]) -> DataFrame:
    """The rows with any of the terms, and s: the corpus's n and mean and the terms' document frequencies df,
    from one scan of all rows."""
    df = F.array(*(F.count_if(F.array_contains("has", t)) for t in terms))
    s = rows.agg(F.struct(F.count("*").alias("n"), F.avg("size").alias("mean"), df.alias("df")).alias("s")).scalar()
    return rows.where(F.size("has") > 0).select("*", s.alias("s"))


def statistics(docs: DataFrame, row_id: str, columns: dict[str, float], **how) -> DataFrame:
    """One row: n (rows of the corpus) and mean (tokens of a row)."""
    return tokenised(docs, row_id, columns, **how).agg(F.count("*").alias("n"), F.avg(_size(columns)).alias("mean"))


def idf(n, df):
    """Of a term that df of n rows have; terms that half of the rows have count next to nothing."""
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, 1e-6).otherwise(raw)


def _part(n, mean, df, f, size):
    """What a term adds to a row's score."""
    return idf(n, df) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean))


def bm25(docs: DataFrame, row_id: str, columns: dict[str, float], terms: list[str], prefix: bool = False, **how) -> DataFrame:
    """(row_id, score) of all rows with any of the terms (or prefixes); a larger score is a better match.

    One scan counts the corpus and the terms' rows, another scores rows where they are.
    """
    terms = list(dict.fromkeys(terms))
    m = _measured(frequencies(docs, row_id, columns, terms, prefix, **how), terms)
    parts = [F.when(F.array_contains("has", t), _part(F.col("s.n"), F.col("s.mean"), F.col("s.df")[i], F.col("f")[i], F.col("size"))).otherwise(0.0) for i, t in enumerate(terms)]
    return m.select("row_id", reduce(lambda a, b: a + b, parts).alias("score"))


def score(p: DataFrame, s: DataFrame) -> DataFrame:
    """(row_id, score) from the postings of a query's terms and the statistics of their corpus."""
    df = p.groupBy("term").agg(F.count("*").alias("df"))  # as many rows as the query has terms
    one = p.join(F.broadcast(df), "term").select("*", s.select("n").scalar().alias("n"), s.select("mean").scalar().alias("mean"))
    return one.groupBy("row_id").agg(F.sum(_part(*map(F.col, ("n", "mean", "df", "f", "size")))).alias("score"))


def store(docs: DataFrame, row_id: str, columns: dict[str, float], path: str, **how) -> None:
    """Writes the index of docs: a file holds the postings of some rows, ordered by term, so that a query reads the pages
    of its terms only. Texts are shuffled once, by row, and their postings are counted and sorted where they then are."""
    size = reduce(lambda a, b: a + b, (F.coalesce(F.octet_length(c), F.lit(0)) for c in columns))
    files = math.ceil((docs.agg(F.sum(size).alias("n")).first().n or 0) / FILE_BYTES)
    dealt = docs.select(*dict.fromkeys([row_id, *columns])).repartition(max(1, files), row_id)
    postings(dealt, row_id, columns, **how).sortWithinPartitions("term", "row_id").write.mode("overwrite").parquet(f"{path}/postings")
    statistics(docs, row_id, columns, **how).write.mode("overwrite").parquet(f"{path}/statistics")


def stored(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """(row_id, score) of the rows of a stored index with any of the terms."""
    return score(spark.read.parquet(f"{path}/postings").where(F.col("term").isin(terms)), spark.read.parquet(f"{path}/statistics"))


def top(scored: DataFrame, k: int, order: str = "best") -> DataFrame:
    """The k best rows; order='literal' gives the k worst, as sorting negative ranks downwards does."""
    by = F.col("score").desc() if order == "best" else F.col("score").asc()
    return scored.orderBy(by, "row_id").limit(k)


def parse(query: str) -> list[list[dict]]:
    """Alternatives (OR) of atoms that must all match: words, prefixes (word*) and phrases ("a b")."""
    out: list[list[dict]] = [[]]
    for m in re.finditer(r'"([^"]*)"|(\S+)', query):
        if m[2] == "OR":
            out.append([])
            continue
        found = re.findall(r"[^\W_]+", (m[1] if m[1] is not None else m[2]).lower())
        if found:
            out[-1].append({"words": found, "prefix": bool(m[2] and m[2].endswith("*"))})
    return [x for x in out if x]


def lines(docs: DataFrame, row_id: str, columns, **how) -> DataFrame:
    """(row_id, t): tokens between spaces, a line a column, so that a word, a prefix or a phrase of one
    column is a substring."""
    t = F.concat(*(F.concat(F.lit(" "), F.array_join(analysis.tokens(c, **how), " "), F.lit(" \n")) for c in columns))
    return docs.select(F.col(row_id).alias("row_id"), t.alias("t"))


def match(docs: DataFrame, row_id: str, columns: list[str], query: str, **how) -> DataFrame:
    """(row_id) of the rows that fit the query; an atom may match in any column, a phrase in one."""
    wanted = parse(query)
    r = lines(docs, row_id, columns, **how)

    def has(atom):
        return F.contains(F.col("t"), F.lit(" " + " ".join(atom["words"]) + ("" if atom["prefix"] else " ")))

    if not wanted:
        return r.where(F.lit(False)).select("row_id")
    return r.where(reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, map(has, alt)) for alt in wanted))).select("row_id")


def relax(docs: DataFrame, row_id: str, columns: dict[str, float], terms: list[str], top_n: int, accept: str = "literal", limit: int = 3, **how) -> tuple[str, DataFrame]:
    """The first level of the ladder that is accepted, and its (row_id, score), ``limit`` rows.

    Levels: all terms; all but the last one, two, ... (down to one); all terms as prefixes; any term. As
    results stop at ``limit``, accept='literal' (more than top_n results) can only hold below it;
    'at_least' takes top_n or more. The last level needs one result. One scan counts all levels.
    """
    if not terms:
        raise ValueError("empty query")
    t = lines(docs, row_id, columns, **how)
    whole, starts = [[F.contains(F.col("t"), F.lit(f" {w}{end}")) for w in terms] for end in (" ", "")]
    both = lambda cs: reduce(lambda a, b: a & b, cs)
    lead = reduce(lambda a, b: a + b, (both(whole[: i + 1]).cast("int") for i in range(len(terms))))
    level = t.select("row_id", lead.alias("lead"), both(starts).alias("prefix"), reduce(lambda a, b: a | b, whole).alias("any"))
    name = accepted(level, len(terms), top_n, accept, limit)
    used = terms if name in ("or", "prefix") else terms[: int(name[4:])]
    rule = {"prefix": "prefix", "or": "any"}.get(name) or f"lead >= {name[4:]}"
    scored = bm25(docs, row_id, columns, used, name == "prefix", **how).join(level.where(rule).select("row_id"), "row_id")
    return name, top(scored, limit)


def accepted(level: DataFrame, n: int, top_n: int, accept: str, limit: int) -> str:
    """The first level of the ladder that is accepted, from level(row_id, lead, prefix, any) of n terms."""
    sums = [F.sum((F.col("lead") >= i).cast("int")).alias(f"and_{i}") for i in range(n, 0, -1)]
    got = level.agg(*sums, F.sum(F.col("prefix").cast("int")).alias("prefix"), F.sum(F.col("any").cast("int")).alias("or")).first().asDict()
    for name, found in got.items():
        found = min(found or 0, limit)
        if name == "or" and found or name != "or" and (found > top_n if accept == "literal" else found >= min(top_n, limit)):
            return name
    raise LookupError("no documents found after generalizing query")


def tfidf(docs: DataFrame, row_id: str, columns: list[str], terms: list[str], **how) -> DataFrame:
    """(row_id, score): by our definition the sum over distinct query terms t in the row of
    sqrt(tf) * idf(t)^2 / sqrt(size), idf = 1 + ln(n / (df + 1)), times the share of query terms found."""
    terms = list(dict.fromkeys(terms))
    m = _measured(frequencies(docs, row_id, dict.fromkeys(columns, 1.0), terms, **how), terms)
    w = [1 + F.log(F.col("s.n") / (F.col("s.df")[i] + 1)) for i in range(len(terms))]
    parts = [F.sqrt(F.col("f")[i]) * x * x / F.sqrt("size") for i, x in enumerate(w)]
    return m.select("row_id", (reduce(lambda a, b: a + b, parts) * F.size("has") / len(terms)).alias("score"))


def by_document(entries: DataFrame, terms: list[str], decimals: int = 6, **how) -> DataFrame:
    """(key, entry, score, n_entries) of every document that any of its entries(key, id, body) answers: the best
    entry (the smallest id among equals), its score, and the number of entries found.

    Entries, whole documents and their chunks, are scored where they are; a task hands on one row for each
    document that it found, so that a document of many chunks is no hot key.
    """
    named = entries.select(F.struct("key", "id").alias("entry"), "body")
    found = tfidf(named, "entry", ["body"], terms, **how).select("row_id.key", "row_id.id", F.round("score", decimals).alias("score"))
    best = F.min(F.struct((-F.col("score")).alias("down"), "id"))
    return found.groupBy("key").agg(best.alias("b"), F.count("*").alias("n_entries")).select("key", F.col("b.id").alias("entry"), (-F.col("b.down")).alias("score"), "n_entries")


#: Query terms that go out at a time, of whole queries; and rows of a batch that are scored at a time.
BATCH_TERMS, BATCH_ROWS = 20_000, 256


def batch(docs: DataFrame, row_id: str, columns: dict[str, float], queries: DataFrame, k: int, decimals: int = 6, **how) -> DataFrame:
    """(query_id, row_id, score, rank) of the k best rows of every query: queries(query_id, term).

    Queries go out in blocks of bounded size. A row is scored where it is, against all queries of a
    block at once, and a task keeps k rows a query, so that no (query, row) pairs are shuffled. Scores
    are rounded to ``decimals``; ties go to the smaller row_id.
    """
    r = tokenised(docs, row_id, columns, **how)
    wanted = queries.select("query_id", "term").distinct()
    # One pass counts rows by term, and all rows and their tokens under no term.
    every = F.array_distinct(F.concat(*(F.col(f"t{i}") for i in range(len(columns)))))
    found = r.select(F.explode(F.concat(every, F.array(F.lit(None).cast("string")))).alias("term"), _size(columns).alias("size"))
    df = checkpoint(found.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("size"))).alias("size")))
    whole = df.where("term is null").first()
    n_rows, mean = (whole.df, whole["size"] / whole.df) if whole else (0, 0.0)
    kinds = {f.name: f.dataType.simpleString() for f in [*r.schema.fields, *queries.schema.fields]}
    query_type, row_type = to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(r.schema["row_id"].dataType)
    weights, out = list(columns.values()), None
    for ids, block in _query_blocks(wanted.join(df.hint("merge"), "term").orderBy("query_id", "term")):
        sent = docs.sparkSession.sparkContext.broadcast((ids, block))

        def run(batches, sent=sent):
            ids, block = sent.value
            vocab = {t: i for i, t in enumerate(block)}
            raw = np.log([(n_rows - n + 0.5) / (n + 0.5) for n, _ in block.values()])
            gain = np.where(raw > 0, raw, 1e-6)
            pairs = sorted((q, i) for i, (_, qs) in enumerate(block.values()) for q in qs)
            of = np.array([i for _, i in pairs])
            starts = np.searchsorted([q for q, _ in pairs], np.arange(len(ids)))
            best: list = [[] for _ in ids]  # (-score, row) in order, k at most
            for b in batches:
                own, size, at, term, weight = b.column(0).to_pylist(), np.zeros(b.num_rows), [], [], []
                for c, w in enumerate(weights):
                    column = b.column(1 + c)
                    lengths = np.diff(column.offsets.to_numpy())
                    words = column.flatten().dictionary_encode()
                    ours = np.array([vocab.get(x, -1) for x in words.dictionary.to_pylist()], dtype=np.int64)
                    code = ours[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
                    row = np.repeat(np.arange(b.num_rows), lengths)
                    size += lengths
                    at.append(row[code >= 0])
                    term.append(code[code >= 0])
                    weight.append(np.full(len(term[-1]), w))
                at, term, weight = map(np.concatenate, (at, term, weight))
                order = np.argsort(at, kind="stable")
                at, term, weight = at[order], term[order], weight[order]
                norm = K1 * (1 - B + B * size / mean)
                for lo in range(0, b.num_rows, BATCH_ROWS):
                    n = min(BATCH_ROWS, b.num_rows - lo)
                    x, y = np.searchsorted(at, [lo, lo + n])
                    f = np.bincount(term[x:y] * n + at[x:y] - lo, weights=weight[x:y], minlength=len(block) * n).reshape(len(block), n)
                    part = gain[:, None] * f * (K1 + 1) / (f + norm[lo : lo + n])
                    got = np.round(np.add.reduceat(part[of], starts, axis=0), decimals)
                    least = np.array([-x[-1][0] if len(x) == k else 0.0 for x in best])
                    for q in np.flatnonzero((got.max(axis=1) >= least) & (got.max(axis=1) > 0)):
                        js = np.flatnonzero((got[q] >= least[q]) & (got[q] > 0))
                        best[q] = sorted(best[q] + [(-got[q, j], own[lo + j]) for j in js])[:k]
            rows = [(q, row, -score) for q, x in zip(ids, best) for score, row in x]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((query_type, row_type, pa.float64()))], ["query_id", "row_id", "score"])

        part = r.mapInArrow(run, f"query_id {kinds['query_id']}, row_id {kinds['row_id']}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return wanted.select("query_id").join(r.select("row_id"), F.lit(False)).select("*", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "row_id")
    return out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _query_blocks(terms: DataFrame):
    """(query ids, {term: (rows with it, [numbers of the queries with it])}) of whole queries, in order."""
    ids: list = []
    block: dict = {}
    size = 0
    for r in terms.select("query_id", "term", "df").toLocalIterator():
        if not ids or ids[-1] != r.query_id:
            if size >= BATCH_TERMS:
                yield ids, block
                ids, block, size = [], {}, 0
            ids.append(r.query_id)
        block.setdefault(r.term, (r.df, []))[1].append(len(ids) - 1)
        size += 1
    if ids:
        yield ids, block


def first_matches(docs: DataFrame, row_id: str, columns: list[str], query: str, limit: int = 10, **how) -> DataFrame:
    """The first rows by id that fit the query."""
    return match(docs, row_id, columns, query, **how).orderBy("row_id").limit(limit)


#: Fixed value: what stands between what a search found and the message.
INSTRUCTIONS = "Use the previous information to answer the following message if it is relevant to answer or complete the following message:\n"


def formatted(prompt="prompt", response="response"):
    return F.concat(F.col(prompt), F.lit("\n"), F.col(response), F.lit("\n"))
