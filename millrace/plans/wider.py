"""More named queries: sources over listings, stored tables, code extraction, and whole paths."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions import vector as V
from millrace.operators import chat, chunking, code, graph, search, tables, vectors
from millrace.plans.catalog import DOC_ROWS, PAIR_ROWS, PAIRS, TERMS, WEIGHTS, _bm25_sql, _chats, _rounded, _supplies, query
from millrace.session import shared_folder, table
from millrace.sources import files


def _folder(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- sources ----------------------------------------------------------------------------------------

TYPES = [".txt", ".md", ".go", ".PY", ".bin", ".json"]
PATH = f"'file:/r/' || coalesce(source, 'none') || CASE WHEN doc_id % 5 = 0 THEN '/vendor' ELSE '' END || '/f' || doc_id || {TYPES}[doc_id % 6 + 1]"


def _listing(spark, d):
    i = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (i % 6 + 1).cast("int"))
    path = F.concat(F.lit("file:/r/"), F.coalesce("source", F.lit("none")), F.when(i % 5 == 0, "/vendor").otherwise(""), F.lit("/f"), i.cast("string"), kind)
    return table(spark, d, "documents").select(path.alias("path"), F.col("text").alias("content"))


@query(f"""SELECT substr(p, 9) AS source, regexp_extract(p, '[^/]+$') AS file_name, regexp_extract(p, '\\.\\w+$') AS file_type, text AS page_content
FROM (SELECT {PATH} AS p, text FROM documents) WHERE regexp_matches(p, '\\.(txt|md|go|json)$')""")
def text_tree(spark, d):
    got = files.as_documents(files.listed(_listing(spark, d)), "/r")
    return got.select("metadata.source", "metadata.file_name", "metadata.file_type", "page_content")


@query(f"SELECT p AS path, text AS content FROM (SELECT {PATH} AS p, text FROM documents) WHERE p LIKE '%.go' AND p NOT LIKE '%vendor/%'")
def go_scan(spark, d):
    return files.go_sources(_listing(spark, d))


@query(f"SELECT p AS path, text AS content FROM (SELECT {PATH} AS p, text FROM documents) WHERE lower(p) LIKE '%.py' AND regexp_extract(p, '[^/]+$') NOT LIKE '%7%'")
def typed_scan(spark, d):
    return files.of_types(_listing(spark, d), [".py"], ignore=["7"])


SITES = "['https://www.cnn.com/', 'https://site.example/', 'https://www.reddit.com/', '/'][page_id % 4 + 1]"


@query(rf"""SELECT DISTINCT page_id, regexp_replace(u, '^(.*?)cnn\.com', '\1lite.cnn.com') AS url FROM (SELECT page_id, unnest(regexp_extract_all(
regexp_replace(replace(html, 'href="/', 'href="' || {SITES}), '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'), '(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1)) AS u FROM pages)
WHERE contains(u, 'http') AND NOT ({" OR ".join(f"contains(u, '{u}')" for u in X.UNWANTED_URLS)})""")
def search_results(spark, d):
    """Links of result pages: absolute ones that no block list names, each once a page."""
    site = F.element_at(F.array(*map(F.lit, ["https://www.cnn.com/", "https://site.example/", "https://www.reddit.com/", "/"])), (F.col("page_id") % 4 + 1).cast("int"))
    p = table(spark, d, "pages").select("page_id", F.replace("html", F.lit('href="/'), F.concat(F.lit('href="'), site)).alias("html"))
    return files.search_results(p)


@query("SELECT 'w' || vec_id AS word, CAST(embedding AS DOUBLE[]) AS vector, CAST(0.5 AS DOUBLE) AS similarity FROM embeddings")
def embedding_file(spark, d):
    e = F.struct(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("Word"), F.col("embedding").cast("array<double>").alias("Vector"), F.lit(0.5).alias("Similarity"))
    return files.parsed_embeddings(table(spark, d, "embeddings").select(F.to_json(F.create_map(e["Word"], e)).alias("value")))


@query(f"""WITH f AS (SELECT text FROM (SELECT {PATH} AS p, text FROM documents) WHERE regexp_matches(p, '\\.(txt|md|go|json)$'))
SELECT 'full' AS kind, count(*) AS n FROM f UNION ALL SELECT 'chunk', CAST(sum(ceil(strlen(text) / 2048.0)) AS BIGINT) FROM f""")
def ingest(spark, d):
    """Files to documents to index entries, full and by chunk."""
    return chunking.index_entries(files.as_documents(files.listed(_listing(spark, d)), "/r")).groupBy("kind").agg(F.count("*").alias("n"))


# --- stored tables ----------------------------------------------------------------------------------


@query("SELECT doc_id, source FROM documents")
def append_read(spark, d):
    docs, path = table(spark, d, "documents").select("doc_id", "source"), _folder(spark, "appended")
    for rest in (0, 1):
        files.append(docs.where(F.col("doc_id") % 2 == rest), path)
    return spark.read.parquet(path)


@query("""SELECT 'documents' AS name, CAST(2 AS INTEGER) AS n_columns, count(*) AS n_rows FROM documents UNION ALL SELECT 'vec_items', 2, count(*) FROM embeddings
UNION ALL SELECT 'edge_log', 4, count(*) FROM lineitem UNION ALL SELECT 'roles', 3, count(*) FROM nation""")
def created_tables(spark, d):
    """Tables that are created, filled from others, and left alone by a second creation."""
    base = _folder(spark, "tables")
    rows = {
        "documents": table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"),
        "vec_items": table(spark, d, "embeddings").select(F.col("vec_id").alias("rowid"), "embedding"),
        "edge_log": _supplies(spark, d),
        "roles": table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit("x").alias("instructions")),
    }
    tables.create(spark, base)
    for name, df in rows.items():
        files.append(df, f"{base}/{name}")
    tables.create(spark, base)
    got = [spark.read.parquet(f"{base}/{n}").agg(F.lit(n).alias("name"), F.lit(len(spark.read.parquet(f"{base}/{n}").columns)).alias("n_columns"), F.count("*").alias("n_rows")) for n in rows]
    return got[0].unionByName(got[1]).unionByName(got[2]).unionByName(got[3])


@query("""WITH old AS (SELECT n_nationkey + 1 AS id, n_name AS name FROM nation WHERE n_nationkey % 2 = 0),
c AS (SELECT n_name AS name, n_nationkey % 3 = 0 AS enabled, 'region ' || n_regionkey AS place FROM nation)
SELECT name, enabled, place, fresh, (SELECT count(*) FROM nation) * 2 + (SELECT count(*) FROM old) AS n_params FROM (SELECT name, CASE WHEN fresh THEN enabled ELSE true END AS enabled, place, fresh FROM (SELECT *, name NOT IN (SELECT name FROM old) AS fresh FROM c))""")
def loaded_tools(spark, d):
    """Tools that are configured anew: missing ones go in, and all parameters are appended."""
    n = table(spark, d, "nation")
    tools = n.where("n_nationkey % 2 = 0").select((F.col("n_nationkey") + 1).cast("long").alias("id"), F.col("n_name").alias("name"), F.lit(True).alias("enabled"))
    params = tools.select("id", F.col("id").alias("tool_id"), F.lit("enabled").alias("param_name"), F.lit("true").alias("param_value"))
    settings = F.explode(F.create_map(F.lit("enabled"), (F.col("n_nationkey") % 3 == 0).cast("string"), F.lit("place"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string"))))
    all_tools, all_params = tables.load_tools(tools, params, n.select(F.col("n_name").alias("name"), settings.alias("param_name", "param_value")))
    places = all_params.where("param_name = 'place'").select(F.col("tool_id").alias("id"), F.col("param_value").alias("place"))
    fresh = all_tools.join(tools.select("id", F.lit(False).alias("fresh")), "id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(True)))
    return fresh.join(places, "id").select("name", "enabled", "place", "fresh", all_params.agg(F.count("*").alias("n")).scalar().alias("n_params"))


@query(f"""WITH f AS (SELECT DISTINCT regexp_replace(p, '/[^/]+$', '') AS dir, p AS path, '├── ' || regexp_extract(p, '[^/]+$') || chr(10) AS line FROM (SELECT {PATH} AS p FROM documents))
SELECT dir, path, line FROM f UNION ALL SELECT DISTINCT dir, NULL, dir || '/' || chr(10) FROM f""")
def file_tree(spark, d):
    """The listing that precedes concatenated files."""
    return tables.file_tree(_listing(spark, d))


@query(_bm25_sql(DOC_ROWS, TERMS))
def stored_index(spark, d):
    """An index that is written once and then asked."""
    path = _folder(spark, "index")
    search.store(table(spark, d, "documents"), "doc_id", {"text": 1.0}, path)
    return _rounded(search.top(search.stored(spark, path, TERMS).withColumn("score", F.round("score", 6)), 25))


@query("""SELECT 'f' || doc_id AS name, 'Function ''f' || doc_id || ''' is too long (' || n || ' lines)' AS description FROM
(SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS n FROM documents) WHERE n > 5""")
def stored_refactorings(spark, d):
    """Findings that are written and then read as a table."""
    f = table(spark, d, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("code"), F.lit("a.go").alias("file_path"), F.lit(1).alias("line_number"))
    path = _folder(spark, "refactorings")
    files.replace(code.long_functions(f, 5), path)
    return spark.read.parquet(path).select("name", "description")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def existing_rows(spark, d):
    return tables.existing(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal > 0 AS VARCHAR) AS credit FROM customer")
def stringified_settings(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") > 0).alias("credit"))
    return tables.stringified(c, c.columns)


@query("""SELECT l_orderkey, max(l_linenumber) AS line FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1 UNION ALL
SELECT l_orderkey, min(l_linenumber) FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY 1""")
def repeated_keys(spark, d):
    """Of rows with one key, an upsert leaves the last, an insert the first."""
    x = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"))
    none = x.limit(0)
    return tables.upsert(none, x.where("l_orderkey % 2 = 0"), "l_orderkey", "line").unionByName(tables.insert_absent(none, x.where("l_orderkey % 2 = 1"), "l_orderkey", "line"))


# --- search and vectors -----------------------------------------------------------------------------


@query(r"""SELECT doc_id FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS t FROM documents) WHERE list_contains(t, 'the') AND list_contains(t, 'thing') ORDER BY doc_id LIMIT 10""")
def fts_first(spark, d):
    """The first ten matches in order of their ids."""
    return search.first_matches(table(spark, d, "documents"), "doc_id", ["text"], "the thing").withColumnRenamed("row_id", "doc_id")


INSTRUCTIONS = search.INSTRUCTIONS.replace("\n", "' || chr(10) || '")


@query(f"""SELECT id, prompt || chr(10) || response || chr(10) AS content, '{INSTRUCTIONS}' AS instructions FROM (
{_bm25_sql(PAIR_ROWS, ["thing", "la"], key="row_id AS id", k=3)}) JOIN (SELECT conv_id * 1000 + turn AS id, prompt, response FROM ({PAIRS})) USING (id)""")
def formatted_results(spark, d):
    """What a relaxed search puts before a message."""
    chats = _chats(spark, d)
    _, hits = search.relax(chats, "id", WEIGHTS, ["thing", "la"], top_n=3)
    return chats.join(hits.select(F.col("row_id").alias("id")), "id").select("id", search.formatted().alias("content"), F.lit(search.INSTRUCTIONS).alias("instructions"))


@query("""SELECT vec_id FROM embeddings WHERE list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) > 0.15""")
def cosine_above(spark, d):
    first = table(spark, d, "embeddings").where("vec_id = 0").select("embedding").scalar()
    return vectors.above(table(spark, d, "embeddings"), first, 0.15, strict=True).select("vec_id")


@query("SELECT vec_id, embedding AS vector FROM embeddings")
def blob32_roundtrip(spark, d):
    return table(spark, d, "embeddings").select("vec_id", V.from_blob32(V.to_blob32(F.col("embedding"))).alias("vector"))


@query("SELECT vec_id AS rowid, CASE WHEN vec_id % 4 = 0 THEN list_reverse(embedding) ELSE embedding END AS embedding FROM embeddings")
def vector_upsert(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("rowid"), "embedding")
    return tables.upsert(e, e.where("rowid % 4 = 0").withColumn("embedding", F.reverse("embedding")), "rowid")


@query("""SELECT doc_id, list_transform(list_sort([{'n': -(length(text) % 2), 'i': 0, 'l': 'a'}, {'n': -(length(text) % 3), 'i': 1, 'l': 'bb'}, {'n': -(length(text) % 4), 'i': 2, 'l': 'ccc'}]), lambda x: x.l) AS ranked
FROM documents WHERE text IS NOT NULL""")
def zero_shot(spark, d):
    """Labels ranked by a scorer of the caller's."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return vectors.classify(docs, "text", ["a", "bb", "ccc"], lambda t, label: F.length(t) % (len(label) + 1)).drop("text")


# --- chunks -----------------------------------------------------------------------------------------


@query("SELECT doc_id, CAST(count(*) AS INTEGER) AS n FROM (SELECT doc_id, unnest(range(0, CAST(ceil(strlen(text) / 300.0) AS BIGINT))) FROM documents) GROUP BY doc_id")
def split_text(spark, d):
    """The live splitter, on which separators and overlap have no effect."""
    c = chunking.split_text(table(spark, d, "documents").select("doc_id", "text"), 300, separators=["\n"], overlap=20)
    return c.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))


LANGUAGES = sorted(chunking.SEPARATORS)
ROUTED = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LANGUAGES))
COUNTED = " ".join(f"WHEN {i} THEN {len(chunking.SEPARATORS[x])}" for i, x in enumerate(LANGUAGES))


@query(f"SELECT doc_id, CASE doc_id % {len(LANGUAGES)} {ROUTED} END AS language, CAST(CASE doc_id % {len(LANGUAGES)} {COUNTED} END AS BIGINT) AS n FROM documents")
def separator_table(spark, d):
    """The separators of each document's language."""
    known = spark.createDataFrame([(x, s) for x in LANGUAGES for s in chunking.separators(x)], "language string, separator string")
    docs = table(spark, d, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, LANGUAGES)), (F.col("doc_id") % len(LANGUAGES) + 1).cast("int")).alias("language"))
    return docs.join(F.broadcast(known), "language").groupBy("doc_id", "language").agg(F.count("*").alias("n"))  # a literal of a few dozen rows


def _interleaved(t, pattern):
    return f"flatten(list_transform(range(1, len(string_split_regex({t}, '{pattern}')) + 1), lambda k: CASE WHEN k <= len(regexp_extract_all({t}, '{pattern}')) THEN [string_split_regex({t}, '{pattern}')[k], regexp_extract_all({t}, '{pattern}')[k]] ELSE [string_split_regex({t}, '{pattern}')[k]] END))"


FIRST_CUT, NEXT_CUT = r"\n+", r"[,.]\s*"


@query(f"""SELECT doc_id, CAST(i AS INTEGER) AS idx, c AS chunk FROM (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS c FROM (
SELECT doc_id, CASE WHEN regexp_matches(text, '{FIRST_CUT}') THEN flatten(list_transform({_interleaved("text", FIRST_CUT)}, lambda p: CASE WHEN strlen(p) >= 200 THEN {_interleaved("p", NEXT_CUT)} ELSE [p] END))
ELSE {_interleaved("text", NEXT_CUT)} END AS l FROM documents WHERE text IS NOT NULL))""")
def recursive_split_patterns(spark, d):
    """Two patterns that are kept: what the first leaves too long is split by the second."""
    return chunking.recursive_split(table(spark, d, "documents").select("doc_id", "text"), [FIRST_CUT, NEXT_CUT], 200, regex=True, keep=True)


@query("""SELECT event_id, 'p' || id AS path FROM (SELECT event_id, 'Brand#' || (event_id % 5 + 1) || (event_id % 4 + 1) AS model FROM events)
JOIN (SELECT p_brand AS model, max(p_partkey) AS id FROM part GROUP BY 1) USING (model)""")
def message_models(spark, d):
    """Messages that name many models, each with the path of the one that was added last; unknown ones go."""
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("Brand#"), (F.col("event_id") % 5 + 1).cast("string"), (F.col("event_id") % 4 + 1).cast("string")).alias("model"))
    m = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"))
    return chat.model_paths(e, m).select("event_id", "path")


# --- graphs -----------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT l_suppkey AS s, l_partkey AS p, epoch_us(l_shipdate) AS v FROM lineitem)
SELECT x AS dst, min(v) AS seen FROM (SELECT s AS x, v FROM e UNION ALL SELECT p, v FROM e) WHERE x IN (SELECT p FROM e WHERE s = 1) GROUP BY x""")
def neighbors_in_order(spark, d):
    return graph.neighbors_in_order(_supplies(spark, d), 1)


NODES = """SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey AS BIGINT) * 2 AS document_id FROM nation UNION ALL
SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY document_id), document_id FROM (SELECT DISTINCT x AS document_id FROM
(SELECT doc_id AS x FROM documents UNION SELECT doc_id // 2 FROM documents) WHERE x NOT IN (SELECT n_nationkey * 2 FROM nation))"""


@query(f"WITH n AS ({NODES}) SELECT a.id AS from_id, b.id AS to_id FROM documents JOIN n a ON a.document_id = doc_id JOIN n b ON b.document_id = doc_id // 2")
def linked_documents(spark, d):
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey").cast("long") * 2).alias("document_id"))
    pairs = table(spark, d, "documents").select(F.col("doc_id").alias("from_document"), F.floor(F.col("doc_id") / 2).cast("long").alias("to_document"))
    return graph.link_documents(nodes, spark.createDataFrame([], "from_id long, to_id long"), pairs)[1]


@query("SELECT doc_id AS id, text, CASE WHEN doc_id % 2 = 1 THEN len(embedding) END AS n FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def saved_documents(spark, d):
    docs, e = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    old = spark.createDataFrame([], "document_id long, vector array<float>")
    all_docs, all_vectors = graph.save_documents(docs.where("id % 2 = 0"), old, docs.where("id % 2 = 1").join(e, "id", "left"))
    return all_docs.join(all_vectors, F.col("id") == F.col("document_id"), "left").select("id", "text", F.when(F.col("vector").isNotNull(), F.size("vector").cast("long")).alias("n"))


# --- code -------------------------------------------------------------------------------------------


def _sources(spark, d):
    """A Go source for each document: a function that calls three others, one of them the next one's."""
    i, n = F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string")
    body = F.concat(
        F.lit("package p"), (F.col("doc_id") % 3).cast("string"), F.lit("\n\n// F"), i, F.lit(" does it.\nfunc F"), i, F.lit("(a int, b string) (int, error) {\n\tvar v"), i,
        F.lit(' = "not(a call)"\n\treturn G'), (F.col("doc_id") % 5).cast("string"), F.lit("(H(a)), F"), n, F.lit("(b)\n}\n"),
    )
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("src/f"), i, F.lit(".go")).alias("path"), body.alias("content"))


@query("""SELECT 'F' || doc_id AS name, 'src/f' || doc_id || '.go' AS file_path, 'p' || doc_id % 3 AS package, 'a int,b string' AS parameters, 'int,error' AS returns, 'F' || doc_id || ' does it.' || chr(10) AS comments,
CAST(4 AS INTEGER) AS line_number, 'G' || doc_id % 5 || ',H,F' || (doc_id + 1) AS calls, CASE WHEN doc_id - 1 IN (SELECT doc_id FROM documents) THEN 'F' || (doc_id - 1) ELSE '' END AS called_by FROM documents""")
def code_functions(spark, d):
    f = code.extract(_sources(spark, d))
    return f.select("name", "file_path", "package", *(F.array_join(c, ",").alias(c) for c in ("parameters", "returns")), "comments", "line_number", *(F.array_join(c, ",").alias(c) for c in ("calls", "called_by")))


@query("SELECT 'v' || doc_id AS name, 'p' || doc_id % 3 AS package, 'unknown' AS type, 'package' AS scope, CAST(5 AS INTEGER) AS line_number FROM documents")
def code_variables(spark, d):
    return code.variables(_sources(spark, d)).select("name", "package", "type", "scope", "line_number")


@query("SELECT 'F' || doc_id AS caller, unnest(['G' || doc_id % 5, 'H', 'F' || (doc_id + 1)]) AS callee, unnest([1, 2, 1])::BIGINT AS n FROM documents")
def code_call_edges(spark, d):
    """Calls as they are recorded: one that is an argument of another once more."""
    return code.call_edges(code.extract(_sources(spark, d), dedup=False))


@query("SELECT 'F' || doc_id AS name, 'src/f' || doc_id || '.go' AS file_path FROM documents WHERE doc_id = 7")
def code_lookup(spark, d):
    return tables.where_equal(code.extract(_sources(spark, d)), name="F7").select("name", "file_path")


@query("SELECT 'F' || doc_id AS name, 'src/f' || doc_id || '.go' AS file_path, '4' AS line_number, 'Summary not available.' AS summary FROM documents")
def code_json(spark, d):
    got = code.as_json(code.extract(_sources(spark, d)))
    return got.select("name", *(F.get_json_object("json", f"$.{c}").alias(c) for c in ("file_path", "line_number", "summary")))


@query("""SELECT 'func F' || doc_id || '(a int, b string) (int, error) {' || chr(10) || chr(9) || 'var v' || doc_id || ' = "not(a call)"' || chr(10) || chr(9) || 'return G' || doc_id % 5 || '(H(a)), F' || (doc_id + 1) || '(b)' || chr(10) || '}' AS chunk,
'Summary not available.' AS summary FROM documents""")
def code_chunks(spark, d):
    return code.chunks(code.extract(_sources(spark, d)))


# --- chat -------------------------------------------------------------------------------------------


@query("SELECT n_name AS name, 'region ' || n_regionkey AS instructions FROM nation")
def role_instructions(spark, d):
    r = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("instructions"))
    return chat.role_map(r).select(F.explode("roles").alias("name", "instructions"))
