"""Queries over the standard tables, one for each corpus operator, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.llm import decontaminate, html, importance, jaccard, kneserney, langid, licenses, linededup, merkle, mixing, quality, secrets, simhash
from millrace.llm.common import table


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "n_langs")


def op2_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup(docs, counts=True)


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS k
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
        FROM documents WHERE text IS NOT NULL)
), f AS (
  SELECT doc_id, i, row_number() OVER d AS p, k, lead(k, 1) OVER d AS k2, lead(k, 2) OVER d AS k3
  FROM l WHERE k <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), w AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY k, k2, k3 ORDER BY doc_id, p) AS n FROM f WHERE k3 IS NOT NULL
), gone AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS p FROM w WHERE n > 1
), marked AS (
  SELECT l.doc_id, l.i, l.line, f.p, gone.p IS NOT NULL AS g
  FROM l LEFT JOIN f USING (doc_id, i) LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.p = f.p
), near AS (
  SELECT *, coalesce(last_value(CASE WHEN p IS NOT NULL THEN g END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), false) AS g1,
    coalesce(first_value(CASE WHEN p IS NOT NULL THEN g END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), false) AS g2
  FROM marked
), kept AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE CASE WHEN p IS NULL THEN NOT (g1 AND g2) ELSE NOT g END), '') AS text,
    count(p) AS n_lines, count(*) FILTER (WHERE g) AS n_removed
  FROM near GROUP BY doc_id
)
SELECT doc_id, kept.text, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
FROM documents LEFT JOIN kept USING (doc_id)
"""


def op3_html_text(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


def op4_decontamination(spark, sf_dir):
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    ids = F.array_sort("items")
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        decontaminate.n_hit().alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (decontaminate.n_hit() > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), hits AS (SELECT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw USING (n, g)),
cover AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op5_license_scan(spark, sf_dir):
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_blocks").cast("long").alias("n_blocks"), F.array_join("licenses", ",").alias("licenses"), "findings")


def op6_mixing(spark, sf_dir):
    return mixing.taken(table(spark, sf_dir, "documents"))


#: Least length-normalised log-likelihood ratio (nats an n-gram) of a document that is kept.
QUALITY_THRESHOLD = -0.03


def op7_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return quality.rules(docs, quality.ratios(docs, trusted), QUALITY_THRESHOLD)


def op8_perplexity(spark, sf_dir):
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return kneserney.classify(table(spark, sf_dir, "documents"), trusted)


def op9_secret_scan(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans")
    )


def op10_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_importance(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The unsigned crc32 of the UTF-8 bytes of x, by the table t of its polynomial.
CRC_TABLE = "list_transform(range(256), lambda c: list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, c))"
CRC = """xor(4294967295, list_reduce(list_transform(range(0, octet_length(encode(x))), lambda i: CAST('0x' || substr(hex(encode(x)), 2 * i + 1, 2) AS BIGINT)),
    lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295))"""

OP11_SQL = rf"""
WITH crc AS MATERIALIZED (SELECT {CRC_TABLE} AS t),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), q AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), f AS MATERIALIZED (
  SELECT rid, x, count(*) AS n FROM (
    SELECT rid, unnest(w) AS x FROM d UNION ALL SELECT rid, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d
    UNION ALL SELECT 0, unnest(w) FROM q UNION ALL SELECT 0, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM q)
  GROUP BY rid, x
), known AS MATERIALIZED (SELECT x, {CRC} % 10000 AS bucket FROM (SELECT DISTINCT x FROM f), crc),
fb AS (SELECT rid, bucket, n FROM f JOIN known USING (x)),
b AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE rid > 0), 0) AS s, coalesce(sum(n) FILTER (WHERE rid = 0), 0) AS t FROM fb GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM b) + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM b) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM b
), m AS (SELECT rid, sum(n) AS n, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight FROM fb JOIN g USING (bucket) WHERE rid > 0 GROUP BY rid
), r AS (
  SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS able,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM d LEFT JOIN m USING (rid)
), o AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS FIRST) AS k, count(*) OVER (PARTITION BY able) AS total FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND k <= 25 * total // 100 THEN k END AS rank FROM o
"""


def op12_merkle_manifest(spark, sf_dir):
    rows = merkle.verified(merkle.manifest(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _part(column):
    return f"coalesce(octet_length(encode(CAST({column} AS VARCHAR))) || ':' || CAST({column} AS VARCHAR), '-')"


def _tree(name, leaves, group):
    """Nodes of the trees of leaves(group, i, h, n) by level, and for each leaf its siblings in order: l or r and digest."""
    return f"""{name}_nodes AS MATERIALIZED (
  SELECT {group} AS g, 0 AS lv, i, h, n FROM {leaves}
  UNION ALL SELECT g, lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM {name}_nodes WHERE n > 1 GROUP BY g, lv, i // 2
), {name}_roots AS (SELECT g, h FROM {name}_nodes WHERE n = 1),
{name}_levels AS (SELECT DISTINCT g, lv FROM {name}_nodes WHERE n > 1),
{name}_paths AS MATERIALIZED (
  SELECT x.{group} AS g, x.i, coalesce(list(CASE WHEN s.h IS NULL THEN '' WHEN s.i < (x.i >> v.lv) THEN 'l' || s.h ELSE 'r' || s.h END ORDER BY v.lv) FILTER (WHERE v.lv IS NOT NULL), []) AS path
  FROM {leaves} x LEFT JOIN {name}_levels v ON v.g IS NOT DISTINCT FROM x.{group}
  LEFT JOIN {name}_nodes s ON s.g IS NOT DISTINCT FROM x.{group} AND s.lv = v.lv AND s.i = xor(x.i >> v.lv, 1) GROUP BY x.{group}, x.i
)"""


OP12_SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {CRC_TABLE} AS t),
rows0 AS MATERIALIZED (
  SELECT doc_id, lang, sha256({" || ".join(_part(c) for c in merkle.COLUMNS)}) AS h,
    CASE WHEN n_chars IS NOT NULL AND (SELECT {CRC.replace("x)", "CAST(doc_id AS VARCHAR))")} FROM crc) % 7 = 0 THEN sha256({" || ".join(_part("(n_chars + 1)" if c == "n_chars" else c) for c in merkle.COLUMNS)}) END AS tampered
  FROM documents
), leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM rows0
), {_tree("low", "leaves", "lang")},
tops AS MATERIALIZED (SELECT g AS lang, h, 0 AS one, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low_roots),
{_tree("high", "tops", "one")},
whole AS (
  SELECT x.doc_id, x.h AS leaf, coalesce(x.tampered, x.h) AS start, s.h AS subroot, (SELECT h FROM high_roots) AS root, list_concat(p.path, q.path) AS path
  FROM leaves x JOIN low_paths p ON p.g IS NOT DISTINCT FROM x.lang AND p.i = x.i JOIN tops s ON s.lang IS NOT DISTINCT FROM x.lang JOIN high_paths q ON q.i = s.i
), folded AS (
  SELECT *, list_reduce(path, lambda a, p: sha256(CASE p[1] WHEN 'l' THEN p[2:] || a WHEN 'r' THEN a || p[2:] ELSE a END), start) AS folded_root FROM whole
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda p: p[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


def op13_jaccard_join(spark, sf_dir):
    return jaccard.classes(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT r, unnest(CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w WHEN 2 THEN [w[1] || ' ' || w[2]] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS x FROM d
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x GROUP BY a.r, b.r),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reached AS (SELECT a AS v, b AS u FROM l UNION SELECT v, l.b FROM reached JOIN l ON l.a = u),
k AS (SELECT v, min(doc_id) AS component_id FROM reached JOIN d ON d.r = u GROUP BY v)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CASE WHEN n.n IS NULL THEN doc_id ELSE component_id END AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN k ON k.v = d.r
"""


def queries():
    return {f.__name__: f for f in (op1_language_id, op2_line_dedup, op3_html_text, op4_decontamination, op5_license_scan, op6_mixing, op7_quality_rules, op8_perplexity, op9_secret_scan, op10_simhash, op11_importance, op12_merkle_manifest, op13_jaccard_join)}


def oracle_sql():
    return {"op2_line_dedup": OP2_SQL, "op4_decontamination": OP4_SQL, "op11_importance": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_jaccard_join": OP13_SQL}
