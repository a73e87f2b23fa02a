"""Secret scans with multipart credential linking.

Strong spans (assign, access, hex) are always reported. Weak candidates (a user or key name, a bare
mixed token, a short assignment, an endpoint) are reported only where a complementary part, weak or
strong, lies beside them (not over them) within SCOPE code points: names want a secret, secrets want a name
or an endpoint, endpoints want a name or a secret. The link is an interval join by sweep: over the ends of
all candidates of a text in order, the last part that has ended and the next that begins, role by role.

Defined results: null texts are empty; spans are in code points, end exclusive; matches that overlap a
strong span are not candidates of their own, and no part completes one that it overlaps; repeated rows each
get their row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import let

SCOPE = 200
#: Matches whose offsets are added up one by one.
BLOCK = 256
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, pattern, smallest length (of group 1 for those that have one), role, strong or weak; in order of report.
KINDS = [
    ("assign", ASSIGN, 8, "secret", True),
    ("access", r"AKIA[A-Z0-9]{12,}+", 0, "name", True),
    ("hex", r"[0-9a-f]{32,}+", 0, "secret", True),
    ("short", ASSIGN, 1, "secret", False),
    ("name", r"""(?i:user(?:name)?|login|client_?id|account_?id|(?:access_)?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}""", 0, "name", False),
    ("mixed", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_a-z-]*[A-Z])(?=[0-9+/_A-Z-]*[a-z])[A-Za-z0-9+/_-]{20,}+=*+(?![A-Za-z0-9+/_=-])", 0, "secret", False),
    ("endpoint", r"""(?i:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|s3)://[^\x20\x09-\x0D"'<>]+""", 0, "endpoint", False),
]
COMPLEMENT = {"name": ["secret"], "secret": ["name", "endpoint"], "endpoint": ["name", "secret"]}
SPAN = "array<struct<start:int,kind:int,stop:int>>"


def _matches(text, pattern: str, number: int, group: bool, least: int, most: int | None = None):
    """Spans of all matches, whose offsets follow from the texts between them (split) and their own."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1 if group else 0))
    parts = F.zip_with(F.zip_with(F.split(text, pattern, -1), hits, lambda s, h: F.struct(F.length(s).alias("gap"), F.length(h).alias("n"))), values, lambda a, v: F.struct(a["gap"].alias("gap"), a["n"].alias("n"), F.length(v).alias("v")))
    parts = F.filter(parts, lambda x: x["n"].isNotNull())
    empty = F.array().cast(SPAN)

    def step(s, x):
        lo = s["at"] + x["gap"]
        ok = (x["v"] >= least) & (F.lit(True) if most is None else x["v"] <= most)
        span = F.array(F.struct(lo.alias("start"), F.lit(number).alias("kind"), (lo + x["n"]).alias("stop")))
        return F.struct((lo + x["n"]).alias("at"), F.when(ok, F.concat(s["out"], span)).otherwise(s["out"]).alias("out"))

    def total(block):
        return F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + x["n"])

    def spans(p):
        # An array that grows is copied at each step: first the blocks' starts, then the spans of each block.
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda i: F.slice(p, i * BLOCK + 1, BLOCK))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, starts(bs), lambda b, at: F.aggregate(b, F.struct(at.alias("at"), empty.alias("out")), step, lambda s: s["out"]))))

    def starts(bs):
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(bs, first, lambda s, b: F.struct((s["at"] + total(b)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    found = let(parts, lambda p: F.when(F.size(p) > 0, spans(p)).otherwise(empty))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, base, weak): strong spans in order, and weak ones."""
    text = F.coalesce(F.col("text"), F.lit(""))
    strong = [_matches(text, p, i, k == "assign", n) for i, (k, p, n, _, is_strong) in enumerate(KINDS) if is_strong]
    weak = [_matches(text, p, i, k == "short", n, 7 if k == "short" else None) for i, (k, p, n, _, is_strong) in enumerate(KINDS) if not is_strong]
    return docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.array_sort(F.concat(*strong)).alias("base"), F.concat(*weak).alias("weak"))


def link(c: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, base, spans) of candidates: spans are base and the linked ones of weak, in order."""
    # Two rows for each candidate, its end and its start (ends first where both are at one place), and one
    # without a candidate that holds the strong spans, so that no other row carries them.
    first = F.array(F.struct(F.lit(None).cast(SPAN[6:-1]).alias("c"), F.col("base").alias("base")))
    rest = F.transform(F.concat("base", "weak"), lambda x: F.struct(x.alias("c"), F.lit(None).cast(SPAN).alias("base")))
    c = c.select("doc_id", "rid", F.explode(F.when(F.size("weak") > 0, F.concat(first, rest)).otherwise(first)).alias("x")).select("doc_id", "rid", "x.*")
    sides = F.when(F.col("c").isNotNull(), F.array(F.struct(F.col("c.stop").alias("at"), F.lit(0).alias("side")), F.struct(F.col("c.start").alias("at"), F.lit(1).alias("side"))))
    e = c.select("*", F.explode_outer(sides).alias("e")).select("doc_id", "rid", "base", "c", "e.*")
    role = F.element_at(F.array(*(F.lit(r) for _, _, _, r, _ in KINDS)), F.col("c.kind") + 1)
    weak = F.element_at(F.array(*(F.lit(not s) for *_, s in KINDS)), F.col("c.kind") + 1)
    begins = F.col("side") == 1
    order = ["at", "side", "c.kind", "c.start"]
    # Both directions run from the first row on: a frame up to the last row is summed anew for each row.
    before = Window.partitionBy("rid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("rid").orderBy(*(F.col(x).desc() for x in order)).rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("role", role).withColumn("weak", weak)
    last, following = F.max(F.when(begins & ~F.col("weak"), F.col("c.stop"))).over(before), F.min(F.when(begins & ~F.col("weak"), F.col("c.start"))).over(after)
    over = F.coalesce(last > F.col("c.start"), F.lit(False)) | (begins & F.coalesce(following < F.col("c.stop"), F.lit(False)))
    e = e.withColumn("part", ~F.col("weak") | ~over)
    near = {}
    for r in ("name", "secret", "endpoint"):
        mine = F.col("part") & (F.col("role") == r)
        ended, begun = F.max(F.when(mine & ~begins, F.col("c.stop"))).over(before), F.min(F.when(mine & begins, F.col("c.start"))).over(after)
        near[r] = F.coalesce(F.when(begins, F.col("c.start") - ended <= scope).otherwise(begun - F.col("c.stop") <= scope), F.lit(False))
    linked = F.lit(False)
    for r, wanted in COMPLEMENT.items():
        for w in wanted:
            linked = linked | ((F.col("role") == r) & near[w])
    e = e.withColumn("linked", F.col("weak") & F.col("part") & linked)
    got = e.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("base", ignorenulls=True).alias("base"), F.collect_set(F.when(F.col("linked"), F.col("c"))).alias("more"))
    return got.select("doc_id", "base", F.array_sort(F.concat("base", "more")).alias("spans"))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, base, spans): base holds the strong spans, spans also the weak ones that are linked,
    each as (start, kind, stop) in order."""
    return link(candidates(docs), scope)


def joined(spans):
    """kind:start:stop of spans, comma-joined."""
    names = F.array(*(F.lit(k) for k, *_ in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
