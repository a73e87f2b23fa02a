"""Code index: functions, variables and calls of Go sources, and reports on them.

Extraction works on declarations at the top level with a scanner for strings and comments; no Go
parser exists in Python. Reports work on any table with the schema of functions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FUNCTION = "name string, file_path string, package string, type string, parameters array<string>, returns array<string>, comments string, code string, line_number int, literal_calls array<string>"
VARIABLE = "name string, file_path string, package string, type string, scope string, line_number int"
QUIET = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|`[^`]*`|'(?:\\.|[^'\\\n])+'""", re.S)
DECLARED = re.compile(r"^func[ \t]*(?:\(([^)]*)\)[ \t]*)?([A-Za-z_]\w*)(?:\[[^\]]*\])?[ \t]*\(", re.M)
CALL = re.compile(r"(?<![\w.)\]])([A-Za-z_]\w*)(?:\.([A-Za-z_]\w*))?\s*\(")
#: Words of the language that parentheses may follow, and its conversions.
NOT_CALLS = frozenset("if for switch select return func go defer range case else var const type import package map chan interface struct".split())
NAME = r"(?i)(?:function|method)\s+([A-Za-z0-9_]+)|([A-Za-z0-9_]+)\s+(?:function|method)"


def _blank(source: str) -> str:
    """source with strings and comments blanked out, position for position."""
    return QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def _closing(s: str, at: int, pair: str = "()") -> int:
    depth = 0
    for i in range(at, len(s)):
        depth += (s[i] == pair[0]) - (s[i] == pair[1])
        if not depth:
            return i
    return len(s) - 1


def _split(s: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in s:
        depth += (c in "([{") - (c in ")]}")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [x.strip() for x in [*out, part] if x.strip()]


def _parameters(s: str) -> list[str]:
    """name type pairs; a type holds for the names before it; parameters without names are left out."""
    parts = [re.sub(r"\s+", " ", p) for p in _split(s)]
    if not any(re.match(r"[A-Za-z_]\w* \S", p) for p in parts):
        return []
    out, kind = [], ""
    for p in reversed(parts):
        name, _, rest = p.partition(" ")
        kind = rest or kind
        out.append(f"{name} {kind}")
    return out[::-1]


def calls_in(body: str, packages=()) -> list[str]:
    """Callees in order, one entry for each argument list a call stands in and one more: a call nested d
    deep as an argument is recorded d + 1 times. pkg.F if pkg is an indexed package, else F."""
    out, spans = [], []
    for m in CALL.finditer(body):
        if m[1] in NOT_CALLS:
            continue
        at = m.end() - 1
        spans.append((at, _closing(body, at)))
        depth = sum(lo < m.start() < hi for lo, hi in spans[:-1])
        name = m[1] if not m[2] else f"{m[1]}.{m[2]}" if m[1] in packages else m[2]
        out += [name] * (depth + 1)
    return out


def functions_in(path: str, source: str, packages=()) -> list[dict]:
    bare, out = _blank(source), []
    package = re.search(r"^package[ \t]+(\w+)", bare, re.M)
    for m in DECLARED.finditer(bare):
        end = _closing(bare, m.end() - 1)
        opening = bare.find("{", end)
        line_end = bare.find("\n", end)
        has_body = opening >= 0 and (line_end < 0 or opening < line_end or "\n" not in bare[end:opening].strip())
        stop = _closing(bare, opening, "{}") + 1 if has_body else (line_end if line_end >= 0 else len(bare))
        result = bare[end + 1 : opening if has_body else stop].strip()
        result = result[1:-1] if result.startswith("(") else result
        returns = [x.split(" ", 1)[1] if re.match(r"[A-Za-z_]\w* \S", x) and not x.startswith(("chan ", "func ", "map ", "struct ", "interface ")) else x for x in _split(result)]
        receiver = re.search(r"([A-Za-z_]\w*)\s*$", m[1]) if m[1] else None
        before = source[: m.start()].rstrip("\n").split("\n") if source[: m.start()].endswith("\n") and not source[: m.start()].endswith("\n\n") else []
        doc = []
        while before and before[-1].startswith("//"):
            doc.insert(0, before.pop()[2:].removeprefix(" "))
        out.append({"name": f"{receiver[1]}.{m[2]}" if receiver else m[2], "file_path": path, "package": package[1] if package else "", "type": "function", "parameters": _parameters(source[m.end() : end]), "returns": returns, "comments": "\n".join(doc) + "\n" * bool(doc), "code": source[m.start() : stop], "line_number": source.count("\n", 0, m.start()) + 1, "literal_calls": calls_in(bare[opening + 1 : stop - 1], packages) if has_body else []})
    return out


def variables_in(path: str, source: str) -> list[dict]:
    """Names declared by var and const, in functions too; scope is always package, as is a missing type unknown."""
    bare, out = _blank(source), []
    package = re.search(r"^package[ \t]+(\w+)", bare, re.M)
    for m in re.finditer(r"^[ \t]*(?:var|const)[ \t]*(\()?", bare, re.M):
        lines = bare[m.end() : _closing(bare, m.end() - 1)].split("\n") if m[1] else [bare[m.end() :].split("\n", 1)[0]]
        at = bare.count("\n", 0, m.end())
        for i, line in enumerate(lines):
            if got := re.match(r"\s*([A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)\s*([^=]*)(?:=|$)", line):
                for name in re.split(r"\s*,\s*", got[1]):
                    out.append({"name": name, "file_path": path, "package": package[1] if package else "", "type": got[2].strip() or "unknown", "scope": "package", "line_number": at + i + 1})
    return out


def _over(files: DataFrame, find, schema: str) -> DataFrame:
    names = [x.split()[0] for x in re.sub(r"<[^>]*>", "", schema).split(", ")]

    def run(batches):
        for b in batches:
            yield pd.DataFrame([r for path, source in zip(b["path"], b["content"]) if source is not None for r in find(path, source)], columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def extract(files: DataFrame, packages=(), dedup: bool = True) -> DataFrame:
    """files(path, content) as functions with calls (once each, or literally) and called_by; of functions
    with one name that in the last file stays."""
    raw = _over(files, lambda p, s: functions_in(p, s, packages), FUNCTION)
    rest = [c for c in raw.columns if c != "name"]
    one = raw.groupBy("name").agg(F.max_by(F.struct(*rest), F.struct("file_path", "line_number")).alias("r")).select("name", "r.*")
    calls = F.array_distinct("literal_calls") if dedup else F.col("literal_calls")
    return with_callers(one.withColumn("calls", calls).drop("literal_calls").withColumn("summary", F.lit("Summary not available.")))


def variables(files: DataFrame) -> DataFrame:
    return _over(files, variables_in, VARIABLE)


def call_edges(functions: DataFrame) -> DataFrame:
    """(caller, callee, n)"""
    return functions.select(F.col("name").alias("caller"), F.explode("calls").alias("callee")).groupBy("caller", "callee").agg(F.count("*").alias("n"))


def callers(functions: DataFrame) -> DataFrame:
    """(name, caller): who calls each of the functions, by exactly that name; a row for each, as all others may
    call one."""
    found = call_edges(functions).select(F.col("callee").alias("name"), "caller")
    return found.join(functions.select("name"), "name", "left_semi")


def with_callers(functions: DataFrame) -> DataFrame:
    """functions with called_by, the record of one repository's index. Reports take ``callers``, whose rows no
    function's fame can make too long."""
    by = callers(functions).groupBy("name").agg(F.array_sort(F.collect_set("caller")).alias("called_by"))
    return functions.join(by, "name", "left").withColumn("called_by", F.coalesce("called_by", F.array().cast("array<string>")))


def counts(functions: DataFrame) -> DataFrame:
    n = callers(functions).groupBy("name").agg(F.count("*").cast("int").alias("n"))
    return functions.join(n, "name", "left").select("name", F.size("calls").alias("total_calls"), F.coalesce("n", F.lit(0)).alias("total_called_by"))


def by_file(functions: DataFrame) -> DataFrame:
    """(file_path, name), in order."""
    return functions.select("file_path", "name").orderBy("file_path", "name")


def exported_by_package(functions: DataFrame) -> DataFrame:
    """(package, name) of exported functions, in order."""
    return functions.where(F.col("name").rlike(r"^\p{Lu}")).select("package", "name").orderBy("package", "name")


def relationships(functions: DataFrame, unknown: str = "External/Unknown") -> DataFrame:
    """(name, direction, other, file_path): calls and callers with their files, unknown ones by a default."""
    calls = functions.select("name", F.lit("calls").alias("direction"), F.explode("calls").alias("other"))
    out = calls.unionByName(callers(functions).select("name", F.lit("called_by").alias("direction"), F.col("caller").alias("other")))
    known = functions.select(F.col("name").alias("other"), "file_path")
    return out.join(known, "other", "left").select("name", "direction", "other", F.coalesce("file_path", F.lit(unknown)).alias("file_path"))


def asked_function(prompt):
    """The function that a prompt names ("function X" or "X method", whichever stands first); null without."""
    p = F.col(prompt) if isinstance(prompt, str) else prompt
    return F.coalesce(*(F.nullif(F.regexp_extract(p, NAME, i), F.lit("")) for i in (1, 2)))


def long_functions(functions: DataFrame, most: int = 100, code: str = "code") -> DataFrame:
    n = F.length(code) - F.length(F.replace(F.col(code), F.lit("\n"), F.lit("")))
    found = functions.withColumn("n_lines", n).where(F.col("n_lines") > most)
    return found.select("name", F.format_string("Function '%s' is too long (%d lines)", "name", "n_lines").alias("description"), F.format_string("%s:%d", "file_path", "line_number").alias("location"), F.lit("major").alias("severity"))


def chunks(functions: DataFrame) -> DataFrame:
    return functions.select(F.col("code").alias("chunk"), "summary")


def as_json(functions: DataFrame) -> DataFrame:
    return functions.select("name", F.to_json(F.struct(*functions.columns)).alias("json"))
