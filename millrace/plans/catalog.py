"""The named queries over the standard tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import analysis
from millrace.functions import text as X
from millrace.functions import vector as V
from millrace.operators import chat, chunking, code, graph, search, tables, vectors
from millrace.session import table
from millrace.sources import files
from millrace.streaming import turns

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


# --- chunks -----------------------------------------------------------------------------------------

SLICES = "SELECT doc_id, i AS idx, array_slice(encode({t}), i * {n} + 1, (i + 1) * {n}) AS b FROM (SELECT *, unnest(range(0, CAST(ceil(strlen({t}) / {n}.0) AS BIGINT))) AS i FROM {f})"


@query(f"SELECT doc_id, CAST(idx AS INTEGER) AS idx, hex(b) AS chunk FROM ({SLICES.format(t='text', n=2048, f='documents')})")
def chunk_by_count(spark, d) -> DataFrame:
    c = chunking.split_by_count(table(spark, d, "documents").select("doc_id", "text"), 2048)
    return c.select("doc_id", "idx", F.hex("chunk_bytes").alias("chunk"))


@query("SELECT source, CAST(sum(ceil(strlen(text) / 2048.0)) AS BIGINT) AS n_chunks FROM documents GROUP BY source")
def chunk_counts(spark, d):
    return chunking.chunk_counts(chunking.split_by_count(table(spark, d, "documents").select("source", "text"), 2048), "source")


def _cut(p: str, seps: list[str], size: int) -> str:
    cases = " ".join(f"WHEN x.used <= {i} AND contains(x.s, {s}) THEN list_transform(string_split(x.s, {s}), lambda y: {{'s': y, 'used': {i + 1}}})" for i, s in enumerate(seps))
    return f"flatten(list_transform({p}, lambda x: CASE WHEN strlen(x.s) >= {size} OR x.used = 0 THEN CASE {cases} ELSE [{{'s': x.s, 'used': {len(seps)}}}] END ELSE [x] END))"


def _split_sql(text: str, seps: list[str], size: int) -> str:
    p = f"[{{'s': {text}, 'used': 0}}]"
    steps, names = [], []
    for i in range(len(seps)):
        names.append(f"p{i}")
        steps.append(f"{_cut(p, seps, size)} AS p{i}")
        p = f"p{i}"
    inner = "SELECT doc_id, text FROM documents WHERE text IS NOT NULL"
    for s in steps:
        inner = f"SELECT *, {s} FROM ({inner})"
    return f"SELECT doc_id, unnest(range(0, len({p}))) AS idx, unnest({p}).s AS chunk FROM ({inner})"


SPLIT_SQL = _split_sql("text", ["chr(10) || chr(10)", "chr(10)", "' '"], 200)


@query(f"SELECT doc_id, CAST(idx AS INTEGER) AS idx, chunk FROM ({SPLIT_SQL})")
def recursive_split_plain(spark, d):
    return chunking.recursive_split_plain(table(spark, d, "documents").select("doc_id", "text"), ["\n\n", "\n", " "], 200)


@query(r"""SELECT doc_id, CAST(i AS INTEGER) AS idx, c AS chunk FROM (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS c FROM (
SELECT doc_id, flatten(list_transform(range(1, len(p) + 1), lambda k: CASE WHEN k <= len(m) THEN [p[k], m[k]] ELSE [p[k]] END)) AS l FROM (
SELECT doc_id, string_split_regex(text, '[,.]\s*|\n+') AS p, regexp_extract_all(text, '[,.]\s*|\n+') AS m FROM documents WHERE text IS NOT NULL)))""")
def recursive_split(spark, d):
    """Separators that are patterns, and are kept."""
    return chunking.recursive_split(table(spark, d, "documents").select("doc_id", "text"), [r"[,.]\s*|\n+"], 200, regex=True, keep=True)


@query(f"""SELECT doc_id, CAST(idx AS INTEGER) AS idx, hex(b) || coalesce(hex(array_slice(lead(b) OVER (PARTITION BY doc_id ORDER BY idx), 1, 16)), '') AS chunk
FROM ({SLICES.format(t="text", n=512, f="documents")})""")
def chunk_overlap(spark, d):
    c = chunking.split_by_count(table(spark, d, "documents").select("doc_id", "text"), 512)
    return chunking.add_overlap(c, 16).select("doc_id", "idx", F.hex("chunk_bytes").alias("chunk"))


@query(f"""SELECT doc_id, CAST(line AS INTEGER) AS idx, CAST(i AS INTEGER) AS sub, hex(array_slice(encode(s), i * 100 + 1, (i + 1) * 100)) AS chunk
FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil(strlen(s) / 100.0) AS BIGINT)))) AS i FROM
  (SELECT doc_id, idx AS line, chunk AS s FROM ({_split_sql("text", ["chr(10)"], 100)})))""")
def enforce_chunk_size(spark, d):
    lines = chunking.recursive_split_plain(table(spark, d, "documents").select("doc_id", "text"), ["\n"], 100)
    return chunking.enforce_size(lines, 100).select("doc_id", "idx", "sub", F.hex("chunk_bytes").alias("chunk"))


def _metadata(docs):
    """Metadata as a loader might give it: some rows name a source, some a type, some a language."""
    some = lambda on, k, v: F.when(on, F.create_map(F.lit(k), v)).otherwise(F.create_map().cast("map<string,string>"))
    i = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, [".py", ".go", ".htm", ".js", ".ts", ".md", ".json", ".txt"])), (i % 8 + 1).cast("int"))
    meta = F.map_concat(some(i % 3 == 0, "source", F.col("source")), some(i % 5 != 0, "file_type", kind), some(i % 7 == 0, "language", F.lit("GO")))
    return docs.select("doc_id", F.col("text").alias("page_content"), meta.alias("metadata"))


KEY_SQL = "CASE WHEN doc_id % 3 = 0 AND source IS NOT NULL THEN source ELSE sha1(text) END"


@query(f"SELECT doc_id, {KEY_SQL} AS key FROM documents")
def document_keys(spark, d):
    return _metadata(table(spark, d, "documents")).select("doc_id", chunking.document_key("metadata", "page_content").alias("key"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'GO' WHEN doc_id % 5 = 0 THEN 'DEFAULT' ELSE
  ['PYTHON', 'GO', 'HTML', 'JS', 'TS', 'MARKDOWN', 'JSON', 'DEFAULT'][doc_id % 8 + 1] END AS language FROM documents""")
def language_route(spark, d):
    return _metadata(table(spark, d, "documents")).select("doc_id", chunking.language_of("metadata").alias("language"))


@query(f"""SELECT {KEY_SQL} AS id, 'full' AS kind, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM documents GROUP BY 1
UNION ALL SELECT key || '-' || i, 'chunk', count(*), NULL FROM (SELECT {KEY_SQL} AS key, unnest(range(0, CAST(ceil(strlen(text) / 2048.0) AS BIGINT))) AS i FROM documents) GROUP BY 1""")
def index_entries(spark, d):
    """Entries of all texts; what bytes chunks have, index_chunks tells (a cut character takes other bytes)."""
    e = chunking.index_entries(_metadata(table(spark, d, "documents")))
    return e.groupBy("id", "kind").agg(F.count("*").alias("n"), F.sum(F.when(F.col("kind") == "full", F.octet_length(F.encode("body", "UTF-8")))).alias("n_bytes"))


@query()
def index_chunks(spark, d):
    """The chunk entries of all texts; tests hold them against slices of the bytes."""
    return chunking.index_entries(_metadata(table(spark, d, "documents"))).where("kind = 'chunk'").select("id", "body")


# --- text -------------------------------------------------------------------------------------------

GO_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TRIM = f"regexp_replace(x, '^{GO_SPACE}+|{GO_SPACE}+$', '', 'g')"


@query(f"""SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(text || chr(10) || ' - item one' || chr(10) || '* B', chr(10)), lambda x: {TRIM}), lambda x: x <> ''),
  lambda x: CASE WHEN upper(replace(x, 'ß', '')) = replace(x, 'ß', '') THEN '## ' || x || chr(10) || chr(10) WHEN regexp_matches(x, '^[*+-] ') THEN x || chr(10) ELSE x || chr(10) || chr(10) END), '') AS md FROM documents""")
def pdf_markdown_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", X.page_markdown(F.concat("text", F.lit("\n - item one\n* B"))).alias("md"))


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, '. ', chr(10) || ' ' || chr(9) || chr(10)), chr(10)), lambda x: {TRIM}), lambda x: x <> ''), chr(10)) AS text FROM documents")
def remove_empty_rows(spark, d):
    return table(spark, d, "documents").select("doc_id", X.remove_empty_rows(F.replace("text", F.lit(". "), F.lit("\n \t\n"))).alias("text"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN t || chr(10) || '```' ELSE t END AS text
FROM (SELECT doc_id, repeat('```', doc_id % 3) || text AS t FROM documents)""")
def close_code_fence(spark, d):
    t = F.concat(F.expr("repeat('```', cast(doc_id % 3 as int))"), "text")
    return table(spark, d, "documents").select("doc_id", X.close_code_fence(t).alias("text"))


URL_TEXT = "'see ' || url || '. also <' || url || '!?> or ' || url || '?!'"
CLEAN = "u"
for _c in ".,;!?":
    CLEAN = f"CASE WHEN {CLEAN} LIKE '%{_c}' THEN {CLEAN}[:-2] ELSE {CLEAN} END"
URL_RE = "'http.*?://[^\\s<>{}|\\\\^`\"]+'"


def _url_text(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("see "), u, F.lit(". also <"), u, F.lit("!?> or "), u, F.lit("?!")).alias("t"))


@query(f"SELECT page_id, list_transform(regexp_extract_all({URL_TEXT}, {URL_RE}), lambda u: {CLEAN}) AS urls FROM pages")
def extract_urls(spark, d):
    return _url_text(spark, d).select("page_id", X.extract_urls("t").alias("urls"))


@query(f"SELECT page_id, list_reduce(list_concat([t], regexp_extract_all(t, {URL_RE})), lambda s, u: replace(s, u, '')) AS text FROM (SELECT page_id, {URL_TEXT} AS t FROM pages)")
def remove_urls(spark, d):
    return _url_text(spark, d).select("page_id", X.remove_urls("t").alias("text"))


@query(r"""SELECT page_id, CAST(i AS INTEGER) AS i, h AS href FROM (SELECT page_id, unnest(range(0, len(l))) AS i, unnest(l) AS h FROM
  (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'), '(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1) AS l FROM pages))""")
def href_extract(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(X.hrefs("html", None)).alias("i", "href"))


BLOCK_URLS = "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://latest.com/x' WHEN 1 THEN 'https://www.cnn.com/' || page_id ELSE url END AS url FROM pages"


def _some_urls(spark, d):
    i = F.col("page_id")
    return table(spark, d, "pages").select("page_id", F.when(i % 4 == 0, "https://latest.com/x").when(i % 4 == 1, F.concat(F.lit("https://www.cnn.com/"), i.cast("string"))).otherwise(F.col("url")).alias("url"))


@query("SELECT page_id, url FROM (" + BLOCK_URLS + ") WHERE NOT (" + " OR ".join(f"contains(url, '{u}')" for u in X.UNWANTED_URLS) + ")")
def url_blocklist(spark, d):
    return _some_urls(spark, d).where(~X.is_unwanted_url("url"))


@query(f"SELECT page_id, regexp_replace(url, 'cnn[.]com', 'lite.cnn.com') AS url FROM ({BLOCK_URLS})")
def url_rewrite(spark, d):
    return _some_urls(spark, d).select("page_id", X.lite_url("url").alias("url"))


STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@query(f"""SELECT item_id, array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(text, '[^\\w\\s*"]', '', 'g'), ' ' || chr(9) || chr(10) || chr(12) || chr(13)), '\\s+'), lambda w: w <> '' AND lower(w) NOT IN ({STOP})), ' ') AS q FROM benchmark""")
def sanitize_query(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.sanitize_query("text").alias("q"))


@query("SELECT page_id, 'page ' || page_id || ' of ' || url || ' {x}' AS prompt FROM pages")
def prompt_template(spark, d):
    return table(spark, d, "pages").select("page_id", X.fill_template(F.lit("page {id} of {url} {x}"), {"url": F.col("url"), "id": F.col("page_id").cast("string")}).alias("prompt"))


@query("SELECT event_id, '{' || props || '}' AS wrapped, regexp_extract(props, '(?s)\\{(.*)\\}', 1) AS inside FROM events")
def brace_text(spark, d):
    return table(spark, d, "events").select("event_id", X.wrap_braces("props").alias("wrapped"), X.inside_braces("props").alias("inside"))


@query("SELECT page_id, split_part(url, '/', -1) AS name, regexp_extract(split_part(url, '/', -1), '(\\.[^.]*)$', 1) AS ext FROM pages")
def file_names(spark, d):
    return table(spark, d, "pages").select("page_id", X.file_name("url").alias("name"), X.file_ext("url").alias("ext"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, to_json({'id': event_id, 'type': event_type}) AS j FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("j"))


@query()
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.page_document("url", "html").alias("text"))


@query()
def pretty_html(spark, d):
    return table(spark, d, "pages").select("page_id", X.pretty_html("html").alias("html"))


# --- search -----------------------------------------------------------------------------------------

TOKENS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"
DOC_TOKENS = f"SELECT doc_id, {TOKENS.format('text')} AS t FROM documents"


@query(f"SELECT doc_id FROM ({DOC_TOKENS}) WHERE list_contains(t, 'the') AND list_contains(t, 'that') AND list_contains(t, 'was')")
def fts_and(spark, d):
    return search.match(table(spark, d, "documents"), "doc_id", ["text"], "the that was").withColumnRenamed("row_id", "doc_id")


@query(f"SELECT doc_id FROM ({DOC_TOKENS}) WHERE (list_contains(t, 'queau') AND list_contains(t, 'leeau')) OR list_contains(t, 'und')")
def fts_or(spark, d):
    return search.match(table(spark, d, "documents"), "doc_id", ["text"], "queau leeau OR und").withColumnRenamed("row_id", "doc_id")


@query(f"SELECT doc_id FROM ({DOC_TOKENS}) WHERE len(list_filter(t, lambda x: starts_with(x, 'theat'))) > 0 AND list_contains(t, 'of')")
def fts_prefix(spark, d):
    return search.match(table(spark, d, "documents"), "doc_id", ["text"], "theat* of").withColumnRenamed("row_id", "doc_id")


@query(f"SELECT doc_id FROM ({DOC_TOKENS}) WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' of the ') AND NOT list_contains(t, 'zzz')")
def fts_phrase(spark, d):
    return search.match(table(spark, d, "documents"), "doc_id", ["text"], '"of the"').withColumnRenamed("row_id", "doc_id")


BM25 = """WITH r AS ({rows}), s AS (SELECT count(*) AS n, avg(size) AS mean FROM (SELECT row_id, sum(len(t)) AS size FROM r GROUP BY row_id)),
z AS (SELECT row_id, CAST(sum(len(t)) AS INTEGER) AS size FROM r GROUP BY row_id),
p AS (SELECT row_id, term, sum(w) AS f FROM (SELECT row_id, w, unnest(t) AS term FROM r) WHERE term IN ({terms}) GROUP BY row_id, term),
i AS (SELECT term, CASE WHEN ln((n - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - count(*) + 0.5) / (count(*) + 0.5)) END AS idf FROM p, s GROUP BY term, n)
SELECT {key}, round(sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM p JOIN i USING (term) JOIN z USING (row_id), s
{where} GROUP BY row_id ORDER BY score {order}, 1 LIMIT {k}"""


def _bm25_sql(rows, terms, key="row_id AS doc_id", order="DESC", k=25, where=""):
    return BM25.format(rows=rows, terms=", ".join(f"'{t}'" for t in terms), key=key, order=order, k=k, where=where)


DOC_ROWS = f"SELECT doc_id AS row_id, {TOKENS.format('text')} AS t, 1.0 AS w FROM documents"
TERMS = ["thing", "queau", "was", "schst", "theat"]


def _rounded(s, key="doc_id"):
    return s.select(F.col("row_id").alias(key), F.round("score", 6).alias("score"))


@query(_bm25_sql(DOC_ROWS, TERMS))
def bm25_topk(spark, d):
    s = search.bm25(table(spark, d, "documents"), "doc_id", {"text": 1.0}, TERMS)
    return _rounded(search.top(s.withColumn("score", F.round("score", 6)), 25))


@query(_bm25_sql(DOC_ROWS, TERMS, order="ASC", k=3))
def bm25_literal_order(spark, d):
    s = search.bm25(table(spark, d, "documents"), "doc_id", {"text": 1.0}, TERMS)
    return _rounded(search.top(s.withColumn("score", F.round("score", 6)), 3, "literal"))


PAIRS = """SELECT conv_id, turn, text AS prompt, r AS response FROM (SELECT conv_id, turn, role, text, lead(role) OVER w AS rr, lead(text) OVER w AS r FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND rr = 'assistant'"""
PAIR_ROWS = " UNION ALL ".join(f"SELECT conv_id * 1000 + turn AS row_id, {TOKENS.format(c)} AS t, {w} AS w FROM ({PAIRS})" for c, w in (("prompt", "2.0"), ("response", "0.75"), ("'assistant'", "1.0")))


def _chats(spark, d):
    p = chat.pairs(table(spark, d, "conversations"))
    return p.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "prompt", "response", F.lit("assistant").alias("model_name"))


WEIGHTS = {"prompt": 2.0, "response": 0.75, "model_name": 1.0}


@query(_bm25_sql(PAIR_ROWS, ["thing", "queau", "la"], key="row_id AS id", k=10))
def bm25_weighted_pairs(spark, d):
    s = search.bm25(_chats(spark, d), "id", WEIGHTS, ["thing", "queau", "la"])
    return _rounded(search.top(s.withColumn("score", F.round("score", 6)), 10), "id")


@query(_bm25_sql(PAIR_ROWS, ["thing", "nosuchword", "theat"], key="row_id AS id, 'or' AS level", k=3))
def fts_relaxation(spark, d):
    level, s = search.relax(_chats(spark, d), "id", WEIGHTS, ["thing", "nosuchword", "theat"], top_n=3)
    return _rounded(s, "id").withColumn("level", F.lit(level))


@query(_bm25_sql(PAIR_ROWS, ["with", "from"], key="row_id AS id, 'and_2' AS level", k=3, where="WHERE row_id IN (SELECT row_id FROM p GROUP BY row_id HAVING count(*) = 2)"))
def fts_relaxation_at_least(spark, d):
    level, s = search.relax(_chats(spark, d), "id", WEIGHTS, ["with", "from", "nosuchword"], top_n=2, accept="at_least")
    return _rounded(s, "id").withColumn("level", F.lit(level))


NO_STOP = "list_filter({}, lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in analysis.ENGLISH) + "))"


def _tfidf_sql(rows, terms, k):
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""WITH r AS ({rows}), p AS (SELECT row_id, term, size, count(*) AS f FROM (SELECT row_id, len(t) AS size, unnest(t) AS term FROM r) WHERE term IN ({listed}) GROUP BY ALL),
i AS (SELECT term, 1 + ln((SELECT count(*) FROM r) / (count(*) + 1)) AS w FROM p GROUP BY term)
SELECT row_id, round(sum(sqrt(f) * w * w / sqrt(size)) * count(*) / {len(terms)}, 6) AS score FROM p JOIN i USING (term) GROUP BY row_id ORDER BY score DESC, 1 LIMIT {k}"""


TFIDF_ROWS = f"SELECT doc_id AS row_id, {NO_STOP.format(TOKENS.format('text'))} AS t FROM documents"


@query(f"SELECT row_id AS doc_id, score FROM ({_tfidf_sql(TFIDF_ROWS, TERMS[:4], 10)})")
def tfidf_match_topk(spark, d):
    s = search.tfidf(table(spark, d, "documents"), "doc_id", ["text"], TERMS[:4], drop=analysis.ENGLISH)
    return _rounded(search.top(s.withColumn("score", F.round("score", 6)), 10))


@query(f"SELECT row_id AS doc_id, score, text || ' ' AS content FROM ({_tfidf_sql(TFIDF_ROWS, TERMS[:4], 10)}) JOIN documents ON doc_id = row_id")
def chunk_search_join(spark, d):
    return vectors.lookup(tfidf_match_topk(spark, d), table(spark, d, "documents")).select("doc_id", "score", F.concat("text", F.lit(" ")).alias("content"))


@query(f"""WITH r AS ({DOC_ROWS}), s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM r),
p AS (SELECT row_id, size, term, count(*) AS f FROM (SELECT row_id, len(t) AS size, unnest(t) AS term FROM r) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest({TOKENS.format("text")}) AS term FROM benchmark),
i AS (SELECT term, CASE WHEN ln((n - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - count(*) + 0.5) / (count(*) + 0.5)) END AS idf FROM p, s GROUP BY term, n),
x AS (SELECT item_id, row_id, round(sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean))), 4) AS score FROM q JOIN p USING (term) JOIN i USING (term), s GROUP BY item_id, row_id)
SELECT item_id, row_id AS doc_id, score FROM x QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, row_id) <= 1""")
def fts_batch(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(analysis.tokens("text")).alias("term"))
    got = search.batch(table(spark, d, "documents"), "doc_id", {"text": 1.0}, q, 1, decimals=4)
    return got.select(F.col("query_id").alias("item_id"), F.col("row_id").alias("doc_id"), "score")


@query(r"""SELECT doc_id FROM (SELECT doc_id, regexp_extract_all(translate(lower(coalesce(text, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\p{L}\p{N}]+') AS t FROM documents)
WHERE len(list_filter(t, lambda x: regexp_full_match(x, 'thing(e|es|s|ed|eds|ing|ings|ness|ful|ative)?'))) > 0""")
def fts_stemmed(spark, d):
    return search.match(table(spark, d, "documents"), "doc_id", ["text"], "thing", stem=True, fold=True).withColumnRenamed("row_id", "doc_id")


# --- vectors ----------------------------------------------------------------------------------------

COS = "list_cosine_similarity(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"
FIRST = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _first_vector(spark, d):
    return table(spark, d, "embeddings").where("vec_id = 0").select("embedding").scalar()


@query(f"SELECT vec_id, round({COS.format('embedding', FIRST)}, 6) AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 10")
def cosine_topk(spark, d):
    return vectors.top_k(table(spark, d, "embeddings"), _first_vector(spark, d), 10).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT vec_id, label, round({COS.format('embedding', FIRST)}, 6) AS similarity FROM embeddings WHERE {COS.format('embedding', FIRST)} >= 0.2")
def cosine_threshold(spark, d):
    return vectors.above(table(spark, d, "embeddings"), _first_vector(spark, d), 0.2).select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query(f"""SELECT query_id, vec_id, round(s, 6) AS similarity FROM (SELECT q.vec_id AS query_id, e.vec_id, {COS.format("q.embedding", "e.embedding")} AS s
FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 5""")
def knn_join(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.knn(e, e.where("vec_id % 20 = 0"), 5).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("""SELECT vec_id, CAST(i AS INTEGER) AS i, round(x / n, 6) AS x FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x,
sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))) AS n FROM embeddings)""")
def l2_normalize(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(V.l2_normalize("embedding")).alias("i", "x")).withColumn("x", F.round("x", 6))


@query("SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings")
def blob_roundtrip(spark, d):
    return table(spark, d, "embeddings").select("vec_id", V.from_blob(V.to_blob(F.col("embedding").cast("array<double>"))).alias("vector"))


@query("SELECT vec_id, embedding AS vector, list_concat(embedding[1:2], embedding[3:3]) AS head FROM embeddings WHERE len(embedding) = 64")
def vector_shape(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", V.checked("embedding", 64).alias("vector"), V.concatenated(F.array(F.slice(e, 1, 2), F.slice(e, 3, 1))).alias("head"))


@query(f"""WITH h AS (SELECT row_id AS doc_id, row_number() OVER (ORDER BY score DESC, row_id) AS rank FROM ({_tfidf_sql(TFIDF_ROWS, TERMS[:4], 10)})),
n AS (SELECT count(*) AS n FROM embeddings)
SELECT h.doc_id, CAST(rank AS INTEGER) AS rank, CASE WHEN {COS.format("embedding", FIRST)} > 0 THEN text || chr(10) ELSE 'No relevant content found.' || chr(10) END AS content
FROM h JOIN documents USING (doc_id), n JOIN embeddings ON true WHERE vec_id = h.doc_id % n""")
def hybrid_rerank(spark, d):
    e = table(spark, d, "embeddings")
    hits = tfidf_match_topk(spark, d)
    hits = hits.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id"))).alias("h")).select(F.posexplode("h").alias("rank", "h")).select(F.col("h.doc_id").alias("doc_id"), (F.col("rank") + 1).alias("rank"))
    docs = table(spark, d, "documents").join(hits.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("text").alias("body"), F.lit("chunk").alias("field"), e.agg(F.count("*").alias("n")).select("n").scalar().alias("n"))
    v = docs.withColumn("vec_id", F.col("doc_id") % F.col("n")).join(e.select("vec_id", "embedding"), "vec_id")
    return vectors.rerank(hits, v, _first_vector(spark, d), least=0.0)


@query("""SELECT vec_id, list_transform(list_sort(list_transform(range(1, 5), lambda i: {'s': -CAST(round(embedding[i], 1) AS DOUBLE), 'i': i})), lambda x: ['a', 'b', 'c', 'd'][x.i]) AS ranked FROM embeddings""")
def rank_labels(spark, d):
    e = F.col("embedding")
    s = table(spark, d, "embeddings").select("vec_id", F.lit(["a", "b", "c", "d"]).alias("labels"), F.transform(F.slice(e, 1, 4), lambda x: F.round(x, 1).cast("double")).alias("scores"))
    return s.select("vec_id", vectors.rank_labels().alias("ranked"))


@query("""SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN -1 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 50 = 0""")
def embedding_upsert(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    new = e.where("vec_id % 10 = 0").withColumn("label", F.lit(-1)).unionByName(e.where("vec_id % 50 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000))
    return tables.upsert(e, new, "vec_id")


@query()
def mock_embeddings(spark, d):
    return table(spark, d, "documents").select("doc_id", V.mock_embedding("doc_id", 8).alias("vector"))


# --- graph ------------------------------------------------------------------------------------------


def _supplies(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("version"), F.lit(False).alias("is_deleted"))


@query("SELECT DISTINCT l_partkey AS dst FROM lineitem WHERE l_suppkey = 1")
def neighbors(spark, d):
    return graph.neighbors(_supplies(spark, d), 1)


@query("SELECT l_partkey AS dst FROM lineitem WHERE l_suppkey = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_suppkey = 2")
def common_neighbors(spark, d):
    return graph.common_neighbors(_supplies(spark, d), 1, 2)


def _visits(spark, d):
    """A log of edges from users to types of events; an error deletes the user's edge to purchases."""
    e = table(spark, d, "events")
    gone = F.col("event_type") == "error"
    return e.select(F.col("user_id").alias("src"), F.when(gone, "purchase").otherwise(F.col("event_type")).alias("dst"), F.unix_micros(F.col("ts").cast("timestamp")).alias("version"), gone.alias("is_deleted"))


VISITS = "SELECT user_id AS src, CASE WHEN event_type = 'error' THEN 'purchase' ELSE event_type END AS dst, epoch_us(ts) AS version, event_type = 'error' AS is_deleted FROM events"
CURRENT = f"SELECT * FROM (SELECT * FROM ({VISITS}) {{}} QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY version DESC, is_deleted DESC) = 1)"
MIDDLE = "(SELECT CAST((min(epoch_us(ts)) + max(epoch_us(ts))) // 2 AS BIGINT) FROM events)"


@query(CURRENT.format(f"WHERE version <= {MIDDLE}") + " WHERE NOT is_deleted")
def edge_versions_asof(spark, d):
    log = _visits(spark, d)
    middle = table(spark, d, "events").agg(((F.min(F.unix_micros(F.col("ts").cast("timestamp"))) + F.max(F.unix_micros(F.col("ts").cast("timestamp")))) / 2).cast("long").alias("m")).select("m").scalar()
    return graph.active(log.withColumn("m", middle).where("version <= m").drop("m"))


@query(CURRENT.format("") + f" WHERE NOT (is_deleted AND version < {MIDDLE})")
def edge_gc(spark, d):
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    middle = table(spark, d, "events").agg(((F.min(t) + F.max(t)) / 2).cast("long").alias("m")).select("m").scalar()
    return graph.collect_garbage(_visits(spark, d), middle)


@query(f"SELECT src, dst, version, is_deleted FROM ({CURRENT.format('')}) WHERE src = 7 AND dst = 'purchase'")
def edge_lookup(spark, d):
    return graph.find_edge(_visits(spark, d), 7, "purchase")


ALL_LINKS = "SELECT doc_id AS src, unnest([(doc_id * 7 + 3) % n, (doc_id + 11) % n]) AS dst FROM documents, (SELECT count(*) AS n FROM documents)"


@query(f"""WITH RECURSIVE l AS ({ALL_LINKS}), r(id) AS (SELECT doc_id FROM documents WHERE doc_id = 0 UNION SELECT l.dst FROM r JOIN l ON l.src = r.id JOIN documents ON doc_id = l.dst WHERE l.dst % 13 <> 0)
SELECT id FROM r""")
def bfs_connected(spark, d):
    """Reachability over links of all documents, to anywhere among them."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    n = docs.count()
    links = docs.select(F.col("id").alias("src"), F.explode(F.array((F.col("id") * 7 + 3) % n, (F.col("id") + 11) % n)).alias("dst"))
    start = spark.createDataFrame([(0,)], "id long")
    return graph.reachable(links, start, docs.where("id % 13 <> 0 or id = 0")).select("id")


@query("SELECT user_id, row_number() OVER (ORDER BY m, user_id) - 1 AS id FROM (SELECT user_id, min(event_id) AS m FROM events GROUP BY user_id)")
def id_dictionary(spark, d):
    return graph.dense_ids(table(spark, d, "events"), "user_id", "event_id")


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation WHERE n_regionkey = 1")
def label_match(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("type"), F.col("n_name").alias("name"))
    return graph.match_label(n, "MATCH (n:R1) RETURN n").select("id", "name")


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey AS BIGINT) * 2 AS document_id FROM nation UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY document_id), document_id FROM (SELECT DISTINCT doc_id AS document_id FROM documents WHERE doc_id NOT IN (SELECT n_nationkey * 2 FROM nation))")
def graph_nodes(spark, d):
    old = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey").cast("long") * 2).alias("document_id"))
    return graph.get_or_create_nodes(old, table(spark, d, "documents").select(F.col("doc_id").alias("document_id")))


# --- code -------------------------------------------------------------------------------------------

FUNCTIONS = """SELECT 'f' || doc_id AS name, 'src/' || doc_id % 7 || '.go' AS file_path, text AS code, CAST(doc_id AS INTEGER) AS line_number,
['f' || (doc_id * 3) % 500, 'ext' || doc_id % 5, 'f' || (doc_id + 1)] AS calls FROM documents"""


def _functions(spark, d):
    i = F.col("doc_id")
    s = lambda x: x.cast("string")
    calls = F.array(F.concat(F.lit("f"), s((i * 3) % 500)), F.concat(F.lit("ext"), s(i % 5)), F.concat(F.lit("f"), s(i + 1)))
    return table(spark, d, "documents").select(F.concat(F.lit("f"), s(i)).alias("name"), F.concat(F.lit("src/"), s(i % 7), F.lit(".go")).alias("file_path"), F.col("text").alias("code"), i.cast("int").alias("line_number"), calls.alias("calls"))


EDGES = f"SELECT name AS caller, unnest(calls) AS callee FROM ({FUNCTIONS})"


@query(f"SELECT f.name, CAST(3 AS INTEGER) AS total_calls, CAST(coalesce(n, 0) AS INTEGER) AS total_called_by FROM ({FUNCTIONS}) f LEFT JOIN (SELECT callee, count(DISTINCT caller) AS n FROM ({EDGES}) GROUP BY callee) e ON callee = f.name")
def call_counts(spark, d):
    return code.counts(_functions(spark, d))


@query(f"SELECT DISTINCT callee AS name, caller FROM ({EDGES}) WHERE callee IN (SELECT name FROM ({FUNCTIONS}))")
def called_by(spark, d):
    return code.callers(_functions(spark, d))


@query(f"SELECT e.caller AS name, e.callee AS other, 'calls' AS direction, coalesce(file_path, 'External/Unknown') AS file_path FROM ({EDGES}) e LEFT JOIN ({FUNCTIONS}) f ON f.name = e.callee UNION ALL SELECT * FROM (SELECT DISTINCT f.name, e.caller, 'called_by', g.file_path FROM ({FUNCTIONS}) f JOIN ({EDGES}) e ON e.callee = f.name JOIN ({FUNCTIONS}) g ON g.name = e.caller)")
def relationship_default(spark, d):
    return code.relationships(_functions(spark, d))


@query(f"""SELECT name, 'Function ''' || name || ''' is too long (' || n || ' lines)' AS description, file_path || ':' || line_number AS location, 'major' AS severity
FROM (SELECT *, length(code) - length(replace(code, chr(10), '')) AS n FROM ({FUNCTIONS})) WHERE n > 20""")
def long_functions(spark, d):
    return code.long_functions(_functions(spark, d), 20)


@query(f"SELECT file_path, name FROM ({FUNCTIONS}) ORDER BY file_path, name")
def functions_by_file(spark, d):
    return code.by_file(_functions(spark, d))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'LoadItems' WHEN 1 THEN 'LoadItems' WHEN 2 THEN 'the' END AS name FROM documents""")
def function_asked(spark, d):
    i = F.col("doc_id") % 4
    p = F.when(i == 0, "function LoadItems").when(i == 1, "LoadItems METHOD").when(i == 2, "the function Foo").otherwise("nothing here")
    return table(spark, d, "documents").select("doc_id", code.asked_function(p).alias("name"))


# --- tables -----------------------------------------------------------------------------------------


@query("""SELECT n_nationkey, n_name, coalesce(string_agg(s_suppkey || ':' || s_name, ',' ORDER BY s_suppkey), '') AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name""")
def tool_preload(spark, d):
    n, s = table(spark, d, "nation").select("n_nationkey", "n_name"), table(spark, d, "supplier")
    p = tables.preload(n, s, n.n_nationkey == s.s_nationkey, ["s_suppkey", "s_name"], "s")
    return p.select("n_nationkey", "n_name", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["s_suppkey"].cast("string"), x["s_name"])), ",").alias("suppliers"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey = 5")
def point_lookup(spark, d):
    return tables.where_equal(table(spark, d, "supplier"), s_suppkey=5).select("s_suppkey", "s_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3 ORDER BY c_custkey LIMIT 1")
def first_by_name(spark, d):
    return tables.first(table(spark, d, "customer"), "c_custkey", c_mktsegment="BUILDING", c_nationkey=3).select("c_custkey", "c_name")


@query("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 1")
def singleton_select(spark, d):
    return tables.replace_single(table(spark, d, "region"), "r_regionkey").select("r_regionkey", "r_name")


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 'renamed' ELSE s_name END AS s_name, s_acctbal FROM supplier")
def update_nonzero(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey")
    return tables.update(s, F.col("s_nationkey") == 3, s_name="renamed", s_acctbal=0.0).drop("s_nationkey")


@query("SELECT s_suppkey, s_suppkey = 2 OR s_suppkey % 3 = 0 AS enabled FROM supplier")
def update_flag(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 3 == 0).alias("enabled"))
    return tables.set_flag(s, F.col("s_suppkey") == 2, "enabled", True)


@query("SELECT c_custkey FROM customer WHERE c_nationkey <> 3")
def delete_where(spark, d):
    return tables.delete(table(spark, d, "customer"), F.col("c_nationkey") == 3).select("c_custkey")


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY r_name), r_name FROM region")
def insert_rows(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return tables.insert(c, table(spark, d, "region").select(F.col("r_name").alias("name")))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'new' FROM part WHERE p_partkey % 2 = 1")
def insert_if_absent(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return tables.insert_absent(p.where("p_partkey % 2 = 0"), p.withColumn("p_name", F.lit("new")), "p_partkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'changed' ELSE p_name END AS p_name FROM part")
def upsert(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return tables.upsert(p, p.where("p_partkey % 5 = 0").withColumn("p_name", F.lit("changed")), "p_partkey")


@query("SELECT p_name AS name, p_brand AS model_type, '/m/' || p_partkey AS path FROM part WHERE p_partkey % 3 <> 0")
def sync_tables(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey"), F.col("p_name").alias("name"), F.col("p_brand").alias("model_type"), F.concat(F.lit("/m/"), F.col("p_partkey").cast("string")).alias("path"))
    return tables.sync(p.where("p_partkey % 2 = 0").drop("p_partkey"), p.where("p_partkey % 3 <> 0").drop("p_partkey"), unique=("name", "model_type", "path"))


@query("SELECT p_brand, min(p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY p_brand")
def first_per_group(spark, d):
    return tables.one_of(table(spark, d, "part").select("p_brand", "p_partkey", "p_name"), ["p_brand"], last=False, order="p_partkey")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_wins(spark, d):
    return tables.latest(table(spark, d, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS v FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def merge_map(spark, d):
    x = table(spark, d, "documents")
    old, new = x.where("doc_id % 3 = 0").select("doc_id", F.col("lang").alias("v")), x.where("doc_id % 2 = 0").select("doc_id", F.col("source").alias("v"))
    return tables.merge_map(old, new, "doc_id", "v")


BEFORE = "CAST(coalesce(sum(strlen({t})) OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at"


@query(f"""SELECT *, {BEFORE.format(t="t", by="source", order="path")} FROM (SELECT source, path, coalesce('--- BEGIN ' || path || ' ---' || chr(10) || text || '--- END ' || path || ' ---' || chr(10) || chr(10), '') AS t
FROM (SELECT source, lpad(doc_id::VARCHAR, 9, '0') AS path, text FROM documents))""")
def file_concat(spark, d):
    x = table(spark, d, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.col("text").alias("content"))
    return tables.concat_ordered(x.select("source", "path", tables.concat_files(x).alias("t")), "source", "path", "t")


@query(f"""SELECT *, {BEFORE.format(t="url", by="g", order="page_id")} FROM (SELECT page_id % 10 AS g, page_id, url || chr(10) || chr(10) AS url FROM pages WHERE url IS NOT NULL AND url <> '' AND page_id % 3 <> 0)""")
def page_concat(spark, d):
    p = table(spark, d, "pages").select((F.col("page_id") % 10).alias("g"), "page_id", F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("url")).alias("url"))
    return tables.concat_pages(p, "g", "page_id", "url")


PATHS = "SELECT '/models/' || p_brand || '/' || lpad(p_partkey::VARCHAR, 7, '0') || ['.onnx', '.GGUF', '.txt', '.bin', '.safetensors'][p_partkey % 5 + 1] AS path, p_brand AS dir FROM part"


def _paths(spark, d):
    ext = F.element_at(F.array(*map(F.lit, [".onnx", ".GGUF", ".txt", ".bin", ".safetensors"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select(F.concat(F.lit("/models/"), "p_brand", F.lit("/"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"), ext).alias("path"))


@query(f"""SELECT path FROM ({PATHS}) p WHERE NOT path LIKE '%.txt' AND path <= coalesce((SELECT min(path) FROM ({PATHS}) q WHERE q.dir = p.dir AND (path LIKE '%.GGUF' OR path LIKE '%.safetensors')), path)""")
def model_scan(spark, d):
    return files.model_files(_paths(spark, d)).select("path")


@query(f"SELECT dir AS name, min(path) AS path, 'safetensors' AS model_type, CAST(0.9 AS DOUBLE) AS top_p FROM ({PATHS}) WHERE path LIKE '%.safetensors' GROUP BY dir")
def first_model_scan(spark, d):
    return files.first_model_per_folder(_paths(spark, d), ".safetensors").select("name", "path", "model_type", "top_p")


@query("SELECT text AS Passage FROM documents WHERE text IS NOT NULL")
def passage_scan(spark, d):
    return files.passages(spark, f"{d}/documents.parquet", "text").withColumnRenamed("text", "Passage")


@query("SELECT l_orderkey, o_orderstatus, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' AND l_quantity > 45")
def order_lookup(spark, d):
    lines = table(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber")
    orders = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return vectors.lookup(lines, orders, "l_orderkey")


# --- chat -------------------------------------------------------------------------------------------


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, CASE WHEN conv_id % 3 = 0 THEN 'complete' WHEN conv_id % 3 = 1 THEN 'open' ELSE 'error' END AS status FROM conversations GROUP BY conv_id")
def delta_accumulate(spark, d):
    c = table(spark, d, "conversations")
    reason = F.when(F.lead("turn").over(_by_conv()).isNull(), F.when(F.col("conv_id") % 3 == 0, "stop").when(F.col("conv_id") % 3 == 2, "content_filter"))
    event = F.to_json(F.struct(F.array(F.struct(reason.alias("finish_reason"), F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    lines = c.select("conv_id", "turn", F.concat(F.lit("data: "), event).alias("line"))
    return chat.accumulate(lines, "conv_id", "turn")


def _by_conv():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id").orderBy("turn")


@query(PAIRS)
def turn_pairs(spark, d):
    return chat.pairs(table(spark, d, "conversations"))


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS turn_no FROM conversations")
def turn_counter(spark, d):
    return chat.numbered(table(spark, d, "conversations").select("conv_id", "turn"))


@query(f"SELECT conv_id, turn, prompt || chr(10) || 'tool' || chr(10) || 'Answer: ' || 'team' || '---' || prompt AS prompt FROM ({PAIRS})")
def prompt_assembly(spark, d):
    t = chat.Tools()
    t.add("echo", lambda p: p)
    t.add("teams", lambda p: F.lit("team"))
    t.add("off", lambda p: F.lit("never"), enabled=False)
    t.add("tool", lambda p: F.lit("tool"))
    p = chat.pairs(table(spark, d, "conversations"))
    return p.select("conv_id", "turn", t.run(F.col("prompt"), teams="teams", instructions="Answer: ", delimiter="---").alias("prompt"))


@query("SELECT event_id, 'p' || CAST((SELECT max(p_partkey) FROM part WHERE p_brand = 'Brand#11') AS VARCHAR) AS path FROM events")
def model_paths(spark, d):
    e = table(spark, d, "events").select("event_id", F.lit("Brand#11").alias("model"))
    m = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"))
    return chat.model_paths(e, m).select("event_id", "path")


@query("SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return turns.event_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query(f"""SELECT conv_id * 1000 + turn AS id, 'User: ' || prompt || chr(10) || 'Assistant: ' || response AS embedded_text,
(conv_id * 1000 + turn) || '-2024-01-02T03:04:05Z' AS entry_id, prompt || chr(10) || response AS body FROM ({PAIRS})""")
def saved_turns(spark, d):
    chats, entries = chat.saved(_chats(spark, d), F.lit("2024-01-02 03:04:05").cast("timestamp"))
    e = entries.select(F.split_part("id", F.lit("-"), F.lit(1)).cast("long").alias("id"), F.col("id").alias("entry_id"), "body")
    return chats.select("id", "embedded_text").join(e, "id")


@query("""WITH l AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem)
SELECT src, dst FROM l WHERE NOT (src = 1 AND dst % 2 = 0) UNION SELECT 1, dst FROM l WHERE src = 1 AND dst % 4 = 0""")
def edge_updates(spark, d):
    e = _supplies(spark, d).select("src", "dst").distinct()
    log = graph.add_edges(spark.createDataFrame([], tables.SCHEMAS["edge_log"]), e, 1)
    log = graph.remove_edges(log, e.where("src = 1 and dst % 2 = 0"), 2)
    return graph.active(graph.add_edges(log, e.where("src = 1 and dst % 4 = 0"), 3)).select("src", "dst")


@query("SELECT url_no, CAST(i AS INTEGER) AS i, u FROM (SELECT url_no, unnest(range(0, len(l))) AS i, unnest(l) AS u FROM (SELECT page_id AS url_no, [url, url || '#a', 'x', 'y'][1:page_id % 4] AS l FROM pages))")
def first_urls(spark, d):
    """At most three URLs of a list; fewer, or none, where there are fewer."""
    u = F.array("url", F.concat("url", F.lit("#a")), F.lit("x"), F.lit("y"))
    p = table(spark, d, "pages").select(F.col("page_id").alias("url_no"), F.slice(u, F.lit(1), (F.col("page_id") % 4).cast("int")).alias("l"))
    return p.select("url_no", F.posexplode(X.first_urls("l")).alias("i", "u"))


@query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS newlines, CASE WHEN doc_id % 2 = 0 THEN 'enabled' ELSE 'disabled' END AS state FROM documents")
def newline_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.count_of("text", "\n").alias("newlines"), X.enabled_label(F.col("doc_id") % 2 == 0).alias("state"))


@query("SELECT 'p' || doc_id % 3 AS package, 'F' || doc_id AS name FROM documents WHERE doc_id % 2 = 0 ORDER BY package, name")
def exported_functions(spark, d):
    i = F.col("doc_id")
    f = table(spark, d, "documents").select(F.concat(F.when(i % 2 == 0, "F").otherwise("f"), i.cast("string")).alias("name"), F.concat(F.lit("p"), (i % 3).cast("string")).alias("package"))
    return code.exported_by_package(f)


@query(f"SELECT row_id AS id, score FROM ({_tfidf_sql('SELECT p_partkey AS row_id, ' + TOKENS.format('p_name') + ' AS t FROM part', ['small', 'ring'], 1)})")
def name_search(spark, d):
    """The best match of a name, as a search for one function gives it."""
    s = search.tfidf(table(spark, d, "part"), "p_partkey", ["p_name"], ["small", "ring"])
    return _rounded(search.top(s.withColumn("score", F.round("score", 6)), 1), "id")


@query("SELECT n_nationkey AS id, 'R' || n_regionkey AS type FROM nation UNION ALL SELECT 25 + r_regionkey, 'S' || r_regionkey FROM region")
def property_nodes(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("type"), F.create_map(F.lit("name"), F.col("n_name")).alias("data"))
    new = table(spark, d, "region").select(F.concat(F.lit("S"), F.col("r_regionkey").cast("string")).alias("type"), F.create_map(F.lit("name"), F.col("r_name")).alias("data"))
    return graph.add_nodes(n, new).select(F.col("id").cast("int").alias("id"), "type")


# --- flagship ---------------------------------------------------------------------------------------


@query(f"""WITH c AS (SELECT doc_id || '-' || idx AS id, doc_id, lower(coalesce(text, '')) AS text FROM (SELECT doc_id, 0 AS idx, text FROM documents)),
top AS ({_bm25_sql("SELECT doc_id AS row_id, " + TOKENS.format("text") + " AS t, 1.0 AS w FROM documents", TERMS, k=10)})
SELECT doc_id, score, text FROM top JOIN documents USING (doc_id)""")
def retrieve(spark, d):
    """Lexical retrieval end to end: tokens, BM25 and the texts of the ten best documents."""
    docs = table(spark, d, "documents")
    hits = search.top(search.bm25(docs, "doc_id", {"text": 1.0}, TERMS).withColumn("score", F.round("score", 6)), 10)
    return vectors.lookup(hits.withColumnRenamed("row_id", "doc_id"), docs).select("doc_id", "score", "text")


from millrace.plans import retrieval, streamed, wider  # noqa: E402,F401  (their queries join these)
