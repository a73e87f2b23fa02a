"""Splitting documents into chunks, and documents into index entries.

Sizes count UTF-8 bytes, so slices may cut a character: ``chunk_bytes`` is exact, ``chunk_text`` has the
replacement character where a cut fell.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Separators by language, in the order in which they are tried.
SEPARATORS = {
    "PYTHON": ["\nclass ", "\ndef ", "\n\n", "\n", " ", ""],
    "GO": ["\nfunc ", "\nvar ", "\nif ", "\n\n", "\n", " ", ""],
    "HTML": ["<div", "<p", "<h1", "<br", "<table", "", "\n"],
    "JS": ["\nfunction ", "\nconst ", "\nlet ", "\nclass ", "\n\n", "\n", " ", ""],
    "TS": ["\nfunction ", "\nconst ", "\nlet ", "\nclass ", "\n\n", "\n", " ", ""],
    "MARKDOWN": ["\n#{1,6} ", "\n---+\n", "\n", " ", ""],
    "JSON": ["}\n", ""],
}
#: Texts of a batch that are Python strings, with their chunks, at a time.
SPLIT_ROWS = 64
#: Languages by file type.
LANGUAGES = {".py": "PYTHON", ".go": "GO", ".html": "HTML", ".htm": "HTML", ".js": "JS", ".ts": "TS", ".md": "MARKDOWN", ".json": "JSON"}


def separators(language: str) -> list[str]:
    if language not in SEPARATORS:
        raise ValueError(f"unsupported language: {language}")
    return SEPARATORS[language]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def byte_slices(text, size: int) -> Column:
    """Consecutive slices of ``size`` bytes, as an array of binaries; none of an empty text."""
    if size <= 0:
        raise ValueError("size must be positive")
    b = F.encode(_c(text), "UTF-8")
    n = F.ceil(F.octet_length(b) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(b, (i - 1) * size + 1, F.lit(size)))).otherwise(F.array().cast("array<binary>"))


def valid_text(b) -> Column:
    return F.make_valid_utf8(_c(b).cast("string"))


def split_by_count(docs: DataFrame, size: int, text: str = "text") -> DataFrame:
    """docs without the text column, with idx, chunk_bytes and chunk_text of each chunk."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(byte_slices(text, size)).alias("idx", "chunk_bytes")).withColumn("chunk_text", valid_text("chunk_bytes"))


def split_text(docs: DataFrame, size: int, text: str = "text", separators=None, overlap: int = 0) -> DataFrame:
    """The live splitter: separators and overlap are accepted but have no effect on it."""
    return split_by_count(docs, size, text)


def split_recursive(s: str, seps: list[str], size: int, regex: bool = False, keep: bool = False) -> list[str]:
    """Split by the first separator that matches (the last one if none does); what is not shorter than
    ``size`` bytes is split on by the separators that follow. Nothing is merged, empty strings stay."""
    if not seps:
        return [s]
    hit = next((i for i, x in enumerate(seps) if re.search(x if regex else re.escape(x), s)), None)
    sep, rest = (seps[-1], []) if hit is None else (seps[hit], seps[hit + 1 :])
    pattern = sep if regex else re.escape(sep)
    if pattern:
        parts, at = [], 0
        for m in re.finditer(pattern, s):
            parts += [s[at : m.start()], *([m[0]] if keep else [])]
            at = m.end()
        parts.append(s[at:])
    else:
        parts = list(s) or [""]
    out = []
    for p in parts:
        out += split_recursive(p, rest, size, regex, keep) if rest and len(p.encode()) >= size else [p]
    return out


def recursive_split(docs: DataFrame, seps: list[str], size: int, text: str = "text", regex: bool = False, keep: bool = False) -> DataFrame:
    """docs without the text column, with idx and chunk. The recursion over arbitrary patterns is no
    expression, hence an Arrow function, which sees nothing but the text."""

    kind = pa.list_(pa.string())

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(s: pa.Array) -> pa.Array:
        few = (s.slice(at, SPLIT_ROWS).to_pylist() for at in range(0, len(s), SPLIT_ROWS))  # the others stay packed
        return pa.concat_arrays([pa.array([], kind), *(pa.array([None if x is None else split_recursive(x, seps, size, regex, keep) for x in part], kind) for part in few)])

    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(run(F.col(text))).alias("idx", "chunk"))


def _used(n: int):
    return lambda x: F.struct(x.alias("s"), F.lit(n).alias("used"))


def recursive_split_plain(docs: DataFrame, seps: list[str], size: int, text: str = "text") -> DataFrame:
    """The same for literal separators that don't repeat one another, in expressions only.

    A piece carries how many separators are used up; each level picks the first unused one it holds.
    """
    level = F.struct(F.col(text).alias("s"), F.lit(0).alias("used"))
    pieces = F.array(level)
    for _ in seps:

        def cut(p):
            long = F.octet_length(F.encode(p["s"], "UTF-8")) >= size
            out = F.array(F.struct(p["s"].alias("s"), F.lit(len(seps)).alias("used")))
            for i in reversed(range(len(seps))):
                parts = F.transform(F.split(p["s"], "\\Q" + seps[i] + "\\E", -1), _used(i + 1))
                out = F.when((p["used"] <= i) & p["s"].contains(seps[i]), parts).otherwise(out)
            return F.when(long | (p["used"] == 0), out).otherwise(F.array(p))

        pieces = F.flatten(F.transform(pieces, cut))
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(F.transform(pieces, lambda p: p["s"])).alias("idx", "chunk"))


def overlapped(chunks, n: int) -> Column:
    """Each chunk of an array of binaries with the first n bytes of the next."""
    c = _c(chunks)
    nxt = F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
    return F.zip_with(c, nxt, lambda a, b: F.concat(a, F.coalesce(F.substring(b, F.lit(1), F.lit(n)), F.lit(b""))))


def add_overlap(chunks: DataFrame, n: int, key: str = "doc_id", body: str = "chunk_bytes") -> DataFrame:
    """The same over one row a chunk: (key, idx) order the chunks of a document."""
    nxt = F.lead(body).over(Window.partitionBy(key).orderBy("idx"))
    return chunks.withColumn(body, F.concat(F.col(body), F.coalesce(F.substring(nxt, F.lit(1), F.lit(n)), F.lit(b""))))


def enforce_size(chunks: DataFrame, size: int, key: str = "doc_id", body: str = "chunk") -> DataFrame:
    """Chunks of more than ``size`` bytes are cut by count; idx and sub order the result."""
    parts = F.when(F.octet_length(F.encode(F.col(body), "UTF-8")) > size, byte_slices(body, size)).otherwise(F.array(F.encode(F.col(body), "UTF-8")))
    return chunks.select(key, "idx", F.posexplode(parts).alias("sub", "chunk_bytes"))


def language_of(metadata, strict: bool = True) -> Column:
    """metadata.language as it is, else by metadata.file_type, else DEFAULT; strict: unknown ones raise."""
    m = _c(metadata)
    kind = F.lit("DEFAULT")
    for ext, lang in LANGUAGES.items():
        kind = F.when(m["file_type"] == ext, lang).otherwise(kind)
    out = F.coalesce(m["language"], kind)
    if not strict:
        return out
    return F.when(out.isin([*SEPARATORS, "DEFAULT"]), out).otherwise(F.raise_error(F.concat(F.lit("unsupported language: "), out)))


def document_key(metadata, text) -> Column:
    """metadata.source where there is one (even an empty one), else the SHA-1 of the text."""
    return F.coalesce(_c(metadata)["source"], F.sha1(F.encode(_c(text), "UTF-8")))


def index_entries(docs: DataFrame, size: int = 2048) -> DataFrame:
    """docs(page_content, metadata) as entries (id, kind, body, file_path): the full document under its
    key, its chunks under key-idx. Equal ids overwrite each other on writing (tables.latest)."""
    d = docs.select("page_content", document_key("metadata", "page_content").alias("key"), F.col("metadata")["source"].alias("file_path"))
    full = d.select(F.col("key").alias("id"), F.lit("full").alias("kind"), F.col("page_content").alias("body"), "file_path")
    parts = d.select("key", "file_path", F.posexplode(byte_slices("page_content", size)).alias("idx", "b"))
    return full.unionByName(parts.select(F.concat_ws("-", "key", "idx").alias("id"), F.lit("chunk").alias("kind"), valid_text("b").alias("body"), "file_path"))


def chunk_counts(chunks: DataFrame, key: str) -> DataFrame:
    return chunks.groupBy(key).agg(F.count("*").alias("n_chunks"))
