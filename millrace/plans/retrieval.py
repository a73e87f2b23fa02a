"""More named queries: a stored index, search in chunks, nearest neighbours and reranking for batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.functions import analysis
from millrace.operators import adjacency, chunking, index, neighbors, search, vectors
from millrace.plans.catalog import COS, CURRENT, DOC_ROWS, DOC_TOKENS, PAIR_ROWS, TERMS, TOKENS, WEIGHTS, _bm25_sql, _chats, _rounded, _visits, query
from millrace.session import shared_folder, table

# --- the stored index -------------------------------------------------------------------------------

_BUILT: dict[tuple, index.Index | str] = {}


def _index(spark, d, name, docs, row_id, columns, **how) -> index.Index:
    """The index of a table, built once in an application and asked from then on."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _BUILT:
        _BUILT[key] = index.create(docs, row_id, columns, f"{shared_folder(spark).rstrip('/')}/index-{name}-{uuid.uuid4().hex}", **how)
    return _BUILT[key]


def _documents(spark, d):
    return _index(spark, d, "documents", table(spark, d, "documents").select("doc_id", "text"), "doc_id", {"text": 1.0})


def _pairs(spark, d):
    return _index(spark, d, "pairs", _chats(spark, d), "id", WEIGHTS)


def _matched(spark, d, q):
    return _documents(spark, d).match(q).withColumnRenamed("row_id", "doc_id")


@query(f"SELECT doc_id FROM ({DOC_TOKENS}) WHERE list_contains(t, 'the') AND list_contains(t, 'that') AND list_contains(t, 'was')")
def index_and(spark, d):
    return _matched(spark, d, "the that was")


@query(f"SELECT doc_id FROM ({DOC_TOKENS}) WHERE (list_contains(t, 'queau') AND list_contains(t, 'leeau')) OR list_contains(t, 'und')")
def index_or(spark, d):
    return _matched(spark, d, "queau leeau OR und")


@query(f"SELECT doc_id FROM ({DOC_TOKENS}) WHERE len(list_filter(t, lambda x: starts_with(x, 'theat'))) > 0 AND list_contains(t, 'of')")
def index_prefix(spark, d):
    return _matched(spark, d, "theat* of")


@query(f"SELECT doc_id FROM ({DOC_TOKENS}) WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' of the ') OR contains(' ' || array_to_string(t, ' ') || ' ', ' the of the ')")
def index_phrase(spark, d):
    return _matched(spark, d, '"of the" OR "the of the"')


@query(r"""SELECT doc_id FROM (SELECT doc_id, regexp_extract_all(translate(lower(coalesce(text, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\p{L}\p{N}]+') AS t FROM documents)
WHERE len(list_filter(t, lambda x: regexp_full_match(x, 'thing(e|es|s|ed|eds|ing|ings|ness|ful|ative)?'))) > 0""")
def index_stemmed(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return _index(spark, d, "stems", docs, "doc_id", {"text": 1.0}, stem=True, fold=True).match("thing").withColumnRenamed("row_id", "doc_id")


@query(_bm25_sql(PAIR_ROWS, ["with", "from"], key="row_id AS id, 'and_2' AS level", k=3, where="WHERE row_id IN (SELECT row_id FROM p GROUP BY row_id HAVING count(*) = 2)"))
def index_relaxation(spark, d):
    level, s = _pairs(spark, d).relax(["with", "from", "nosuchword"], top_n=2, accept="at_least")
    return _rounded(s, "id").withColumn("level", F.lit(level))


@query(_bm25_sql(DOC_ROWS, TERMS))
def index_topk(spark, d):
    """The best documents, from blocks of postings that can hold one of them."""
    return _documents(spark, d).top(TERMS, 25).withColumnRenamed("row_id", "doc_id")


@query(f"""WITH r AS ({DOC_ROWS}), s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM r),
p AS (SELECT row_id, size, term, count(*) AS f FROM (SELECT row_id, len(t) AS size, unnest(t) AS term FROM r) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest({TOKENS.format("text")}) AS term FROM benchmark),
i AS (SELECT term, CASE WHEN ln((n - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - count(*) + 0.5) / (count(*) + 0.5)) END AS idf FROM p, s GROUP BY term, n),
x AS (SELECT item_id, row_id, round(sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean))), 4) AS score FROM q JOIN p USING (term) JOIN i USING (term), s GROUP BY item_id, row_id)
SELECT item_id, row_id AS doc_id, score FROM x QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, row_id) <= 3""")
def index_batch(spark, d):
    """The best documents for every prompt of a table: queries meet postings by term and block."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(analysis.tokens("text")).alias("term"))
    return _documents(spark, d).best(q, 3, decimals=4).select(F.col("query_id").alias("item_id"), F.col("row_id").alias("doc_id"), "score")


#: Documents of three writes: all but every fifth; then every third anew, in capitals or as the old text of another; then every seventh goes.
FINAL = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(coalesce(text, '')) || ' thing theat' ELSE text END AS text FROM documents WHERE (doc_id % 5 <> 0 OR doc_id % 3 = 0) AND doc_id % 7 <> 0"
FINAL_ROWS = f"SELECT doc_id AS row_id, {TOKENS.format('text')} AS t, 1.0 AS w FROM ({FINAL})"
FINAL_SQL = f"SELECT 'segments' AS state, * FROM ({_bm25_sql(FINAL_ROWS, TERMS)}) UNION ALL SELECT 'merged', * FROM ({_bm25_sql(FINAL_ROWS, TERMS)})"


@query(FINAL_SQL)
def index_segments(spark, d):
    """An index that is written, appended to with rows that overwrite, deleted from and merged, asked before and after."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    path = f"{shared_folder(spark).rstrip('/')}/index-segments-{uuid.uuid4().hex}"
    ix = index.create(docs.where("doc_id % 5 <> 0"), "doc_id", {"text": 1.0}, path)
    new = docs.where("doc_id % 3 = 0").select("doc_id", F.concat(F.upper(F.coalesce("text", F.lit(""))), F.lit(" thing theat")).alias("text"))
    ix = index.append(ix, new)
    ix = index.append(ix, docs.where("false"), removed=docs.where("doc_id % 7 = 0").select(F.col("doc_id").alias("row_id")))
    merged = index.merge(ix)
    return ix.top(TERMS, 25).withColumn("state", F.lit("segments")).unionByName(merged.top(TERMS, 25).withColumn("state", F.lit("merged"))).withColumnRenamed("row_id", "doc_id")


# --- search in chunks -------------------------------------------------------------------------------

#: A slice of bytes as text: what a cut left of a character goes, as it is no letter.
CUT = r"decode(unhex(regexp_replace(regexp_replace(hex({b}), '^([89AB][0-9A-F]){{1,3}}', ''), '([CD][0-9A-F]|E[0-9A-F]|E[0-9A-F][89AB][0-9A-F]|F[0-9A-F]|F[0-9A-F][89AB][0-9A-F]|F[0-9A-F]([89AB][0-9A-F]){{2}})$', '')))"
ENTRIES = f"""SELECT 'doc/' || doc_id AS key, 'doc/' || doc_id AS id, text FROM documents WHERE text IS NOT NULL UNION ALL
SELECT 'doc/' || doc_id, 'doc/' || doc_id || '-' || i, {CUT.format(b="array_slice(encode(text), i * 2048 + 1, (i + 1) * 2048)")} FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(strlen(text) / 2048.0) AS BIGINT))) AS i FROM documents)"""
NO_STOP = "list_filter({}, lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in analysis.ENGLISH) + "))"


@query(f"""WITH r AS (SELECT key, id, {NO_STOP.format(TOKENS.format("text"))} AS t FROM ({ENTRIES})),
p AS (SELECT key, id, term, size, count(*) AS f FROM (SELECT key, id, len(t) AS size, unnest(t) AS term FROM r) WHERE term IN ({", ".join(f"'{t}'" for t in TERMS[:4])}) GROUP BY ALL),
i AS (SELECT term, 1 + ln((SELECT count(*) FROM r) / (count(*) + 1)) AS w FROM p GROUP BY term),
s AS (SELECT key, id, round(sum(sqrt(f) * w * w / sqrt(size)) * count(*) / 4, 6) AS score FROM p JOIN i USING (term) GROUP BY key, id)
SELECT key, id AS entry, score, n_entries FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, id) AS r, count(*) OVER (PARTITION BY key) AS n_entries FROM s) WHERE r = 1""")
def chunk_search(spark, d):
    """Documents by their best entry, whole or chunk, and how many of their entries were found."""
    docs = table(spark, d, "documents").where("text is not null")
    docs = docs.select(F.col("text").alias("page_content"), F.create_map(F.lit("source"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))).alias("metadata"))
    entries = chunking.index_entries(docs).select(F.col("file_path").alias("key"), "id", "body")
    return search.by_document(entries, TERMS[:4], drop=analysis.ENGLISH)


# --- neighbours -------------------------------------------------------------------------------------

CELLS = 16


def _neighbours(spark, d, probes):
    e = table(spark, d, "embeddings")
    key = (spark.sparkContext.applicationId, d, "vectors")
    if key not in _BUILT:
        path = f"{shared_folder(spark).rstrip('/')}/index-vectors-{uuid.uuid4().hex}"
        neighbors.store(e, path, CELLS)
        _BUILT[key] = path
    got = neighbors.search(spark, _BUILT[key], e.where("vec_id % 20 = 0"), 5, probes)
    return got.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query()
def neighbor_index(spark, d):
    """Nearest rows by a stored index of cells, of which three quarters are probed (recall: tests)."""
    return _neighbours(spark, d, CELLS * 3 // 4)


@query(f"""SELECT query_id, vec_id, round(s, 6) AS similarity FROM (SELECT q.vec_id AS query_id, e.vec_id, {COS.format("q.embedding", "e.embedding")} AS s
FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 5""")
def neighbor_index_exact(spark, d):
    """The same index with all its cells probed."""
    return _neighbours(spark, d, CELLS)


@query(f"""SELECT a.vec_id, min(CASE WHEN b.embedding = a.embedding THEN b.vec_id END) AS same_as, count(*) - 1 AS n_links
FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id OR {COS.format("a.embedding", "b.embedding")} >= 0.35 GROUP BY a.vec_id""")
def similar_vectors(spark, d):
    """How many rows each row is similar to, over all pairs."""
    return neighbors.links_above(table(spark, d, "embeddings"), 0.35)


# --- reranking for a batch --------------------------------------------------------------------------

FIELDS = {"chunk": (3, 0.0), "full_content": (5, 0.05), "summary": (7, -0.05)}
CASES = " ".join(f"WHEN '{f}' THEN {least}" for f, (_, least) in FIELDS.items())
HITS = f"""WITH r AS (SELECT doc_id AS row_id, {TOKENS.format("text")} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM r),
p AS (SELECT row_id, size, term, count(*) AS f FROM (SELECT row_id, len(t) AS size, unnest(t) AS term FROM r) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest({TOKENS.format("text")}) AS term FROM benchmark),
i AS (SELECT term, CASE WHEN ln((n - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - count(*) + 0.5) / (count(*) + 0.5)) END AS idf FROM p, s GROUP BY term, n),
x AS (SELECT item_id, row_id, round(sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean))), 4) AS score FROM q JOIN p USING (term) JOIN i USING (term), s GROUP BY item_id, row_id)
SELECT item_id, row_id AS doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, row_id) AS rank FROM x QUALIFY rank <= 10"""


@query(f"""SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank, coalesce(string_agg(body, '' ORDER BY field) FILTER (WHERE s > least) || chr(10), 'No relevant content found.' || chr(10)) AS content FROM (
  SELECT h.item_id, h.doc_id, h.rank, field, CASE field WHEN 'chunk' THEN substr(text, 1, 40) WHEN 'full_content' THEN coalesce(source, '') ELSE coalesce(lang, '') END AS body,
    {COS.format("v.embedding", "q.embedding")} AS s, CASE field {CASES} END AS least
  FROM ({HITS}) h JOIN documents d USING (doc_id), (SELECT count(*) AS n FROM embeddings), (VALUES {", ".join(f"('{f}', {k})" for f, (k, _) in FIELDS.items())}) AS fields(field, k)
  JOIN embeddings v ON true JOIN embeddings q ON true WHERE v.vec_id = (h.doc_id * k) % n AND q.vec_id = h.item_id % n AND d.text IS NOT NULL)
GROUP BY item_id, doc_id, rank""")
def rerank_batch(spark, d):
    """Ten hits for every prompt, each with what its three fields hold above their cuts for that prompt."""
    e, items, docs = table(spark, d, "embeddings"), table(spark, d, "benchmark"), table(spark, d, "documents").where("text is not null")
    terms = items.select(F.col("item_id").alias("query_id"), F.explode(analysis.tokens("text")).alias("term"))
    hits = _documents(spark, d).best(terms, 10, decimals=4).select(F.col("query_id").alias("prompt_id"), F.col("row_id").alias("doc_id"), "rank")
    n = e.agg(F.count("*").alias("n")).select("n").scalar()
    vector = e.select("vec_id", F.col("embedding"))
    prompts = items.select(F.col("item_id").alias("prompt_id"), (F.col("item_id") % n).alias("vec_id")).join(vector, "vec_id").select("prompt_id", "embedding")
    bodies = {"chunk": F.substring("text", 1, 40), "full_content": F.coalesce("source", F.lit("")), "summary": F.coalesce("lang", F.lit(""))}
    held = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), bodies[f].alias("body"), F.lit(k).alias("k")) for f, (k, _) in FIELDS.items())))
    fields = docs.select("doc_id", held.alias("f")).select("doc_id", "f.field", "f.body", ((F.col("doc_id") * F.col("f.k")) % n).alias("vec_id")).join(vector, "vec_id").drop("vec_id")
    got = vectors.rerank_batch(hits, fields, prompts, {f: least for f, (_, least) in FIELDS.items()})
    return got.select(F.col("prompt_id").alias("item_id"), "doc_id", "rank", "content")


# --- compacted adjacency ----------------------------------------------------------------------------

STEPS = [(1, 3), (2, 3), (3, 3)]
AT = "(SELECT CAST(min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) * {} // {} AS BIGINT) FROM events)"


@query(" UNION ALL ".join(f"SELECT {i} AS step, src, dst, version FROM ({CURRENT.format(f'WHERE version <= {AT.format(i, n)}')}) WHERE NOT is_deleted" for i, n in STEPS))
def compacted_edges(spark, d):
    """The edges at three cutoffs, each from the table of the one before and the changes since."""
    log, base = _visits(spark, d), f"{shared_folder(spark).rstrip('/')}/adjacency-{uuid.uuid4().hex}"
    first, last = log.agg(F.min("version"), F.max("version")).first()
    before, at, out = None, first - 1, []
    for i, n in STEPS:
        until, name = first + (last - first) * i // n, f"adjacency_{uuid.uuid4().hex}"
        delta = log.where((F.col("version") > at) & (F.col("version") <= until))
        if before:
            adjacency.merged(spark, before, delta, name, path=f"{base}/{i}")
            spark.sql(f"DROP TABLE {before}")  # its files stay
        else:
            adjacency.compact(delta, name, path=f"{base}/{i}")
        out.append(spark.read.parquet(f"{base}/{i}").where("not is_deleted").select(F.lit(i).alias("step"), "src", "dst", "version"))
        before, at = name, until
    spark.sql(f"DROP TABLE {before}")
    return out[0].unionByName(out[1]).unionByName(out[2])
