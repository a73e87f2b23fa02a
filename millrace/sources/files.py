"""Sources: Parquet, file trees, model files, Go sources, PDF pages, embeddings, passages and configuration.

All reads go through Spark's readers, so any file system that Spark knows will do.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X

#: File types of text files and of model files.
TEXT_TYPES = [".txt", ".md", ".go", ".py", ".js", ".ts", ".html", ".json", ".css"]
MODEL_TYPES = [".onnx", ".gguf", ".safetensors", ".ckpt", ".bin"]
#: Settings of a model that is found on disk.
MODEL_DEFAULTS = {"temperature": 0.5, "top_p": 0.9, "top_k": 50, "repetition_penalty": 1.1, "ctx": 4096}


def passages(spark: SparkSession, path: str, column: str = "Passage") -> DataFrame:
    """The column of a Parquet table whose rows are strings; others are skipped."""
    df = spark.read.parquet(path)
    if not isinstance(df.schema[column].dataType, T.StringType):
        return spark.createDataFrame([], f"{column} string")
    return df.where(F.col(column).isNotNull()).select(column)


def tree(spark: SparkSession, root: str, pattern: str | None = None, keep: bool = True) -> DataFrame:
    """(path, file_name, file_type, size, content) of all files below root; keep=False leaves content unread."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    f = (r.option("pathGlobFilter", pattern) if pattern else r).load(root)
    cols = [F.col("path"), X.file_name("path").alias("file_name"), X.file_ext("path").alias("file_type"), F.col("length").alias("size")]
    return f.select(*cols, *([F.make_valid_utf8(F.col("content").cast("string")).alias("content")] if keep else []))


def text_documents(spark: SparkSession, root: str, accept=None) -> DataFrame:
    """Text files of a checked-out tree as (page_content, metadata); types are case-sensitive, ``accept`` is
    a condition on (path, file_name, file_type, size, content)."""
    f = tree(spark, root)
    return as_documents(f if accept is None else f.where(accept), root)


def listed(files: DataFrame) -> DataFrame:
    """A listing (path, content) with the columns of ``tree``."""
    return files.select("path", X.file_name("path").alias("file_name"), X.file_ext("path").alias("file_type"), F.octet_length(F.encode("content", "UTF-8")).cast("long").alias("size"), "content")


def as_documents(files: DataFrame, root: str) -> DataFrame:
    """The text files of a tree as (page_content, metadata)."""
    rel = X.relative_path(F.regexp_replace("path", r"^\w+:(//)?", ""), re.sub(r"^\w+:(//)?", "", root))
    meta = F.create_map(F.lit("source"), rel, F.lit("file_path"), rel, F.lit("file_name"), F.col("file_name"), F.lit("file_type"), F.col("file_type"))
    return files.where(F.col("file_type").isin(TEXT_TYPES)).select(F.col("content").alias("page_content"), meta.alias("metadata"))


def typed_files(spark: SparkSession, roots: list[str], types: list[str], ignore=(), recursive: bool = True) -> DataFrame:
    """(path, content) of files below the roots, by type."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(roots)
    return of_types(f.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content")), types, ignore)


def of_types(files: DataFrame, types: list[str], ignore=()) -> DataFrame:
    """Files by type, whatever its case, without those whose name holds a part of ignore."""
    f = files.where(F.lower(X.file_ext("path")).isin([t.lower() for t in types]))
    for part in ignore:
        f = f.where(~X.file_name("path").contains(part))
    return f.select("path", "content")


def go_files(spark: SparkSession, root: str) -> DataFrame:
    return go_sources(tree(spark, root, "*.go"))


def go_sources(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").endswith(".go") & ~F.col("path").contains("vendor/")).select("path", "content")


def _folder(path="path"):
    return F.regexp_replace(path, r"/[^/]*\z", "")


def model_files(files: DataFrame, skip_after_hit: bool = True) -> DataFrame:
    """Model files of a listing (path). With skip_after_hit a folder ends, in order of names, with its
    first .gguf or .safetensors file."""
    f = files.select("path", _folder().alias("dir"), X.file_name("path").alias("name"), F.lower(X.file_ext("path")).alias("ext"))
    first = F.min(F.when(F.col("ext").isin(".gguf", ".safetensors"), F.col("name"))).over(Window.partitionBy("dir"))
    f = f.withColumn("first", first) if skip_after_hit else f.withColumn("first", F.lit(None).cast("string"))
    return f.where(F.col("ext").isin(MODEL_TYPES) & (F.col("first").isNull() | (F.col("name") <= F.col("first")))).select("path", "dir", "name", "ext")


def first_model_per_folder(files: DataFrame, ext: str) -> DataFrame:
    """The first file of a type by name in every folder, named after the folder, with default settings."""
    f = files.select("path", _folder().alias("dir")).where(F.col("path").endswith(ext))
    f = f.groupBy("dir").agg(F.min("path").alias("path"))
    kind = ext.lstrip(".")
    return f.select(F.element_at(F.split("dir", "/"), -1).alias("name"), "path", F.lit(kind).alias("model_type"), *(F.lit(v).alias(k) for k, v in MODEL_DEFAULTS.items()))


def pdf_documents(pages: DataFrame) -> DataFrame:
    """pages(path, page, text) as documents: pages as markdown, in order of their numbers."""
    p = pages.select("path", F.struct("page", X.page_markdown("text").alias("md")).alias("p")).groupBy("path").agg(F.array_sort(F.collect_list("p")).alias("p"))
    meta = F.create_map(F.lit("source"), F.col("path"), F.lit("file_path"), F.col("path"), F.lit("file_name"), X.file_name("path"), F.lit("file_type"), F.lit(".pdf"))
    return p.select(F.array_join(F.transform("p", lambda x: x["md"]), "").alias("page_content"), meta.alias("metadata"))


def embeddings_json(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector, similarity) of JSON files that map words to embeddings."""
    return parsed_embeddings(spark.read.text(path, wholetext=True))


def parsed_embeddings(texts: DataFrame) -> DataFrame:
    kind = "map<string,struct<Word:string,Vector:array<double>,Similarity:double>>"
    m = texts.select(F.explode(F.from_json("value", kind)).alias("word", "e"))
    return m.select("word", F.col("e.Vector").alias("vector"), F.col("e.Similarity").alias("similarity"))


def embedding_response(body) -> F.Column:
    """All vectors of an embedding response, in order of their index, as one."""
    got = F.from_json(body, "struct<data:array<struct<index:int,embedding:array<double>>>>")
    return F.flatten(F.transform(F.array_sort(got["data"]), lambda d: d["embedding"]))


def embedded(df: DataFrame, text: str, embed, size: int = 768, batch: int = 10, attempts: int = 3, workers: int = 3) -> DataFrame:
    """df with vector, from embed(list of texts) -> list of vectors, in the order of the rows: batches of ``batch``, of
    which up to ``workers`` are in flight in a task, each tried ``attempts`` times with a pause that grows with
    the attempts (30 s at most, and up to a second by chance). A last failure, an answer with more or fewer
    vectors than texts, and another number of dimensions are errors. The embedder is a service or a model of the caller's."""
    import random
    import time
    from concurrent.futures import ThreadPoolExecutor

    schema = T.StructType([*df.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])

    def attempt(texts):
        for n in range(1, attempts + 1):
            try:
                got = embed(texts)
                break
            except OSError:
                if n == attempts:
                    raise
                time.sleep(min(n * n, 30) + random.random())
        if len(got) != len(texts) or any(len(v) != size for v in got):
            raise ValueError(f"expected {len(texts)} vectors of {size} dimensions")
        return got

    def run(batches):
        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                parts = pool.map(attempt, (b[text].iloc[i : i + batch].tolist() for i in range(0, len(b), batch)))
                yield b.assign(vector=pd.Series([v for p in parts for v in p], index=b.index))

    return df.mapInPandas(run, schema)


def search_results(pages: DataFrame, page: str = "html", by: str = "page_id") -> DataFrame:
    """(by, url): distinct links of result pages that no block list names, rewritten to lite sites."""
    links = pages.select(by, F.explode(X.hrefs(page)).alias("url")).distinct()
    return links.where(~X.is_unwanted_url("url")).withColumn("url", X.lite_url("url"))


def robots_allows(status) -> F.Column:
    """Whether a page may be fetched, by the status of robots.txt: a fetch that failed (null) refuses."""
    return F.col(status).isNotNull() if isinstance(status, str) else status.isNotNull()


def config(text: str) -> dict:
    """A configuration of nested mappings, lists and scalars: JSON, or YAML where PyYAML is installed."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ImportError("a YAML configuration needs PyYAML") from e
    return yaml.safe_load(text)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Writes the next version of a table; readers keep the old one until its folder is switched."""
    df.write.mode("overwrite").parquet(path)


def write_concat(parts: DataFrame, by: str, text: str, path: str) -> None:
    """Parts (by, text, at), each of which ends in a newline, as files: those below a group's folder, in order
    of their names, are its concatenation."""
    lines = parts.select(by, "at", F.regexp_replace(text, r"\n\z", "").alias("value"))
    lines.where("value <> ''").repartitionByRange(by, "at").sortWithinPartitions(by, "at").select(by, "value").write.partitionBy(by).mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
