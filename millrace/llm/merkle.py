"""Merkle manifest of a dataset: a leaf for each row, a tree for each language, one root, a proof for each row.

Trees are reduced by superblocks: indices are dealt into buckets of fanout^k, applyInPandas collapses the k
levels of a bucket at once (proofs of its members and its root), and the bucket roots are reduced likewise
until one is left. A row's proof is its lower proof followed by that of its bucket, and so on up to the
root; these meet by (group, bucket), so that a key never has more than fanout^k rows.

Defined results: a null is `-` in a leaf; a null doc_id comes first in its language and isn't tampered with;
rows with one doc_id are ordered by leaf, equal rows in any order (their leaves are equal); repeated rows each
get their leaf and proof; rows without a language have a tree of their own, the first; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpoint, numbered

#: Children of a node, and levels that are collapsed at once (1,024 rows a bucket).
FANOUT, LEVELS = 2, 10
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf(values: dict) -> F.Column:
    """The digest of a row: each column as byte count and value."""
    parts = []
    for c in COLUMNS:
        v = values.get(c, F.col(c)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered): tampered is the leaf of a row with 1 added to n_chars, where that is due."""
    due = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    return docs.select("doc_id", F.col("lang").cast("string").alias("lang"), leaf({}).alias("leaf"), F.when(due, leaf({"n_chars": F.col("n_chars") + 1})).alias("tampered"))


def collapse(nodes: list[str], n: int, fanout: int, levels: int) -> tuple[list, list, str]:
    """Of one bucket's nodes in order, where n are at their level in the whole tree: each one's siblings to the
    left and to the right, level by level, and the bucket's root. A level is hashed while n > 1."""
    lefts, rights, at = [[] for _ in nodes], [[] for _ in nodes], list(range(len(nodes)))
    now = nodes
    while levels and n > 1:
        for i, q in enumerate(at):
            first = q - q % fanout
            lefts[i].append("".join(now[first:q]))
            rights[i].append("".join(now[q + 1 : first + fanout]))
            at[i] = q // fanout
        now = [sha256("".join(now[j : j + fanout]).encode()).hexdigest() for j in range(0, len(now), fanout)]
        n, levels = -(-n // fanout), levels - 1
    return lefts, rights, now[0]


def reduce(nodes: DataFrame, carried: list[str], fanout: int, levels: int) -> list[DataFrame]:
    """Rounds of (lang, at, n, node, carried columns, lefts, rights, top), from the leaves up, until each
    lang has one node; nodes(lang, at, n, node) and the carried columns (strings) in the first round."""
    size, out = fanout**levels, []

    def run(key, pdf):
        pdf = pdf.sort_values("at")
        pdf["lefts"], pdf["rights"], top = collapse(pdf["node"].tolist(), int(pdf["n"].iloc[0]), fanout, levels)
        pdf["top"] = top
        return pdf.drop(columns="bucket")

    while True:
        kept = ["lang", "at", "n", "node", *carried]
        schema = ", ".join(f"{c} {'long' if c in ('at', 'n') else 'string'}" for c in kept)
        done = nodes.select(*kept, F.floor(F.col("at") / size).alias("bucket")).groupBy("lang", "bucket").applyInPandas(run, f"{schema}, lefts array<string>, rights array<string>, top string")
        out.append(checkpoint(done))
        if (out[-1].agg(F.max("n")).first()[0] or 0) <= size:
            return out
        nodes, carried = out[-1].where(F.col("at") % size == 0).select("lang", F.floor(F.col("at") / size).alias("at"), F.ceil(F.col("n") / size).alias("n"), F.col("top").alias("node")), []


def joined(lower: DataFrame, upper: DataFrame, on) -> DataFrame:
    """lower with the proofs of upper(__lang, __at, up_lefts, up_rights, other columns) behind its own."""
    both = lower.join(upper.hint("merge"), on)
    own = [c for c in lower.columns if c not in ("lefts", "rights")]
    more = [c for c in upper.columns if c not in ("__lang", "__at", "up_lefts", "up_rights")]
    return both.select(*own, *more, F.concat("lefts", "up_lefts").alias("lefts"), F.concat("rights", "up_rights").alias("rights"))


def _above(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.col("lang").alias("__lang"), F.col("at").alias("__at"), F.col("lefts").alias("up_lefts"), F.col("rights").alias("up_rights"), *more)


def manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, tampered, subroot, root, lefts, rights) of every row: the siblings on both sides of its path,
    level by level up to the root, each side one string of digests."""
    size, same = fanout**levels, F.col("lang").eqNullSafe(F.col("__lang"))
    rows = numbered(leaves(docs), ["lang"], ["doc_id", "leaf"]).select("lang", "at", "n", F.col("leaf").alias("node"), F.col("doc_id").cast("string").alias("doc_id"), "tampered")
    rounds = reduce(rows, ["doc_id", "tampered"], fanout, levels)
    subroots = numbered(rounds[-1].where("at = 0").select("lang", F.col("top").alias("node")), [], ["lang"])
    # Above the languages there is one tree; what tells its nodes apart, their language, is carried along.
    tops = reduce(subroots.select(F.lit("").alias("lang"), "at", "n", "node", F.col("lang").alias("of")), ["of"], fanout, levels)
    up = tops[-1].withColumn("root", F.col("top"))
    for lower in reversed(tops[:-1]):
        up = joined(lower, _above(up, "root"), same & (F.floor(F.col("at") / size) == F.col("__at")))
    up = up.select(F.col("of").alias("lang"), "at", "lefts", "rights", "root", F.col("node").alias("subroot"))
    # Each language has one bucket in the last round, so a language's row meets a bucket's rows at most.
    up = joined(rounds[-1], _above(up, "root", "subroot"), same)
    for lower in reversed(rounds[:-1]):
        up = joined(lower, _above(up, "root", "subroot"), same & (F.floor(F.col("at") / size) == F.col("__at")))
    return up.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType), F.col("node").alias("leaf"), "tampered", "subroot", "root", "lefts", "rights")


def proof_digest() -> F.Column:
    return F.sha2(F.concat(F.array_join(F.zip_with("lefts", "rights", lambda a, b: F.concat(a, b)), "")), 256)


def folded(start) -> F.Column:
    """The root that follows from a leaf's digest and its siblings."""
    return F.aggregate(F.arrays_zip(F.col("lefts").alias("l"), F.col("rights").alias("r")), start, lambda h, p: F.sha2(F.concat(p["l"], h, p["r"]), 256))


def verified(rows: DataFrame) -> DataFrame:
    """The manifest's rows with proof_sha256, folded_root (from the tampered leaf, where there is one) and verified."""
    rows = rows.withColumn("proof_sha256", proof_digest()).withColumn("folded_root", folded(F.coalesce("tampered", "leaf")))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
