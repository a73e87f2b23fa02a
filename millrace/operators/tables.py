"""Tables: point reads, inserts, updates, deletes, upserts, synchronisation and nested reads.

Every mutation is a DataFrame of the table's next version, to be written to a new folder and switched to;
an immutable table needs no locks, and a failed write leaves the old version as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import checkpoint

#: Tables of the application, by name.
SCHEMAS = {
    "documents": "page_content string, metadata map<string,string>",
    "chats": "id bigint, prompt string, response string, model_name string, embedding binary",
    "chat_postings": "row_id bigint, term string, size int, f double",
    "vec_items": "rowid bigint, embedding array<float>",
    "models": "id bigint, name string, path string, model_type string, temperature double, top_p double, top_k bigint, repetition_penalty double, ctx bigint",
    "selected_models": "id bigint, model_name string, model_path string",
    "tools": "id bigint, name string, enabled boolean",
    "tool_params": "id bigint, tool_id bigint, param_name string, param_value string",
    "url_trackings": "id bigint, url string",
    "roles": "id bigint, name string, instructions string",
    "sessions": "id bigint, created_at timestamp, turns array<struct<id:bigint,user_prompt:string,responses:array<struct<id:bigint,content:string,model:string>>>>",
    "nodes": "id bigint, type string, data map<string,string>",
    "edges": "src bigint, dst bigint, type string, data map<string,string>",
    "edge_log": "src bigint, dst bigint, version bigint, is_deleted boolean",
    "functions": "name string, file_path string, package string, type string, parameters array<string>, returns array<string>, comments string, summary string, code string, called_by array<string>, calls array<string>, line_number int",
}


def create(spark: SparkSession, base: str, names=None) -> None:
    """Empty tables where there are none yet."""
    for name in names or SCHEMAS:
        spark.createDataFrame([], SCHEMAS[name]).write.mode("ignore").parquet(f"{base}/{name}")


def _all(pairs) -> Column:
    return reduce(lambda a, b: a & b, pairs)


def where_equal(df: DataFrame, **values) -> DataFrame:
    return df.where(_all(F.col(k).eqNullSafe(F.lit(v)) for k, v in values.items()))


def first(df: DataFrame, key: str = "id", **values) -> DataFrame:
    """The row with the smallest key among those with these values."""
    return (where_equal(df, **values) if values else df).orderBy(key).limit(1)


def existing(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    return df.join(keys, on, "left_semi")


def insert(df: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """df and new, whose rows get the keys that follow the largest; ``new`` is a batch, ordered by its columns."""
    start = df.agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).select("m").scalar()
    rest = [c for c in new.columns if c != key]
    number = numbered(new.select(*rest), *rest, name="__n")
    return df.unionByName(number.select((F.col("__n") + 1 + start).cast("long").alias(key), *rest))


def numbered(df: DataFrame, *order, name: str) -> DataFrame:
    """df with numbers from 0 in the given order. Rows are range-partitioned by it; each partition numbers
    its own and starts where those before it end, so no task has to hold all of them."""
    parts = checkpoint(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sizes = parts.groupBy("__p").agg(F.count("*").alias("n"))
    starts = sizes.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    at = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return parts.withColumn("__at", at).join(F.broadcast(starts), "__p").select(*df.columns, (F.col("__base") + F.col("__at")).alias(name))  # one row a partition


def one_of(df: DataFrame, key: list[str], last: bool, order=None) -> DataFrame:
    """One row of each key: the first or last by ``order`` (by the rest of the row, where there is none)."""
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    by = F.col(order) if isinstance(order, str) else F.to_json(F.struct(*rest)) if order is None else order
    pick = F.max_by if last else F.min_by
    return df.groupBy(*key).agg(pick(F.struct(*rest), by).alias("__r")).select(*key, "__r.*").select(df.columns)


def is_zero(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        zero = c == ""
    elif isinstance(kind, T.BooleanType):
        zero = ~c
    elif isinstance(kind, T.NumericType):
        zero = c == 0
    else:
        zero = F.lit(False)
    return c.isNull() | zero


def update(df: DataFrame, where: Column, **values) -> DataFrame:
    """Rows that fit take the values; zero values ("" 0 False null) leave a column as it is."""
    kinds = {f.name: f.dataType for f in df.schema}
    new = {c: F.when(where & ~is_zero(F.lit(v), kinds[c]), F.lit(v).cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items()}
    return df.withColumns(new)


def set_flag(df: DataFrame, where: Column, column: str, value: bool) -> DataFrame:
    """Sets a flag to either value; an error when no row fits."""
    if df.where(where).limit(1).isEmpty():
        raise LookupError("no row to update")
    return df.withColumn(column, F.when(where, F.lit(value)).otherwise(F.col(column)))


def delete(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def replace_single(choices: DataFrame, key: str = "id", **values) -> DataFrame:
    """The one row of a singleton table: the first choice with these values; none if there is none."""
    return first(choices, key, **values)


def insert_absent(df: DataFrame, new: DataFrame, on, order=None) -> DataFrame:
    """df and the rows of new whose key it hasn't; of equal keys in new the first by ``order`` goes in."""
    on = [on] if isinstance(on, str) else on
    return df.unionByName(one_of(new.join(df, on, "left_anti"), on, last=False, order=order).select(df.columns))


def load_tools(tools: DataFrame, params: DataFrame, configured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tools(id, name, enabled) and tool_params(id, tool_id, param_name, param_value) after a load of configured(name,
    param_name, param_value): tools that aren't there are inserted, enabled as their parameter of that name says
    (not, without one), and all parameters are appended, also those of tools that were there, once for each load.

    Of tools with one name the first is meant. A null name is no tool; a null value is kept as it is."""
    c = configured.where("name is not null")
    new = c.groupBy("name").agg(F.coalesce(F.max(F.when(F.col("param_name") == "enabled", F.col("param_value") == "true")), F.lit(False)).alias("enabled"))
    all_tools = insert(tools, new.join(tools, "name", "left_anti").select("name", "enabled"))
    ids = all_tools.groupBy("name").agg(F.min("id").alias("tool_id"))
    rows = c.where("param_name is not null").join(ids, "name").select("tool_id", "param_name", F.col("param_value").cast("string").alias("param_value"))
    return all_tools, insert(params, rows)


def upsert(df: DataFrame, new: DataFrame, key, order=None) -> DataFrame:
    """new's rows take the place of df's with the same key; of equal keys in new the last by ``order`` stays."""
    key = [key] if isinstance(key, str) else key
    return df.join(new.select(*key), key, "left_anti").select(df.columns).unionByName(one_of(new, key, last=True, order=order).select(df.columns))


def latest(log: DataFrame, key, version: str, *ties) -> DataFrame:
    """The row with the largest version of every key: aggregated before the shuffle, with no window
    over a key's whole history."""
    key = [key] if isinstance(key, str) else key
    rest = [c for c in log.columns if c not in key]
    picked = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(version, *ties)).alias("r"))
    return picked.select(*key, "r.*").select(log.columns)


def merge_map(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Both maps, new values first."""
    n = new.select(key, F.col(value).alias("__new"), F.lit(True).alias("__is"))
    return old.join(n, key, "full_outer").select(key, F.when(F.col("__is"), F.col("__new")).otherwise(F.col(value)).alias(value))


def sync(table: DataFrame, found: DataFrame, path: str = "path", unique=("name", "model_type")) -> DataFrame:
    """table with what was found and isn't in it yet, without rows whose path wasn't found."""
    added = found.join(table, list(unique), "left_anti").select(table.columns)
    return table.unionByName(added).join(found.select(path).distinct(), path, "left_semi").select(table.columns)


def preload(parents: DataFrame, children: DataFrame, on: Column, child_columns: list[str], name: str) -> DataFrame:
    """parents with an array of their children, ordered by child_columns; empty without any."""
    child = F.struct(*(F.col(c) for c in child_columns))
    rest = parents.columns
    return parents.join(children, on, "left").groupBy(*rest).agg(F.array_sort(F.collect_list(F.when(F.col(child_columns[0]).isNotNull(), child))).alias(name))


def concat_ordered(df: DataFrame, by: str, order, text: str) -> DataFrame:
    """(by, order, text, at): the concatenation of every group's texts, a row for each part, with the byte at
    which it begins; a null text is empty, a null group is one. No group has to fit a task or a row: parts are
    range-partitioned by group and order, and of the groups only the one that runs on into a partition has a
    base there. Of equal orders the smaller text is first."""
    order = [order] if isinstance(order, str) else order
    d = df.select(by, *order, F.coalesce(text, F.lit("")).alias(text)).withColumn("__n", F.octet_length(text).cast("long"))
    parts = checkpoint(d.repartitionByRange(by, *order, text).withColumn("__p", F.spark_partition_id()))
    before = lambda *keys: F.coalesce(F.sum("__n").over(Window.partitionBy(*keys[:-1]).orderBy(*keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = parts.groupBy(F.col(by).alias("__by"), F.col("__p").alias("__q")).agg(F.sum("__n").alias("__n"))
    bases = sizes.withColumn("__base", before("__by", ["__q"])).where("__base > 0").drop("__n")
    own = parts.withColumn("__at", before("__p", by, [*order, text]))
    met = own.join(F.broadcast(bases), (F.col("__p") == F.col("__q")) & F.col(by).eqNullSafe(F.col("__by")), "left")  # one row a partition at most
    return met.select(by, *order, text, (F.col("__at") + F.coalesce("__base", F.lit(0))).cast("long").alias("at"))


def file_tree(files: DataFrame, path: str = "path") -> DataFrame:
    """(dir, path, line) of the listing that precedes concatenated files: a line for each folder that holds any, and
    one for each file in it; ordered by dir and path, in which a folder's own line has a null path. A path
    without a folder stands under "."."""
    name = F.element_at(F.split(path, "/"), -1)
    folder = F.when(F.contains(path, F.lit("/")), F.expr(f"left({path}, length({path}) - length(element_at(split({path}, '/'), -1)) - 1)")).otherwise(".")
    lines = files.where(F.col(path).isNotNull()).select(folder.alias("dir"), F.col(path).alias("path"), F.concat(F.lit("├── "), name, F.lit("\n")).alias("line")).distinct()
    heads = lines.select("dir").distinct().select("dir", F.lit(None).cast("string").alias("path"), F.concat("dir", F.lit("/\n")).alias("line"))
    return heads.unionByName(lines)


def concat_files(files: DataFrame, path: str = "path", content: str = "content") -> Column:
    """A file between its delimiters, as in a concatenated listing; no newline is put before the end."""
    return F.concat(F.lit("--- BEGIN "), F.col(path), F.lit(" ---\n"), F.col(content), F.lit("--- END "), F.col(path), F.lit(" ---\n\n"))


def concat_pages(pages: DataFrame, by, order: str, text: str) -> DataFrame:
    """Fetched pages in order, each followed by a blank line, as ``concat_ordered`` has them; empty ones are left out."""
    full = pages.where(F.col(text).isNotNull() & (F.col(text) != ""))
    return concat_ordered(full.withColumn(text, F.concat(text, F.lit("\n\n"))), by, order, text)


def stringified(df: DataFrame, columns) -> DataFrame:
    """df with the columns, whatever their type, as the strings that settings are kept as."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})
