"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII characters. A window is
``window`` consecutive words of one item, or a shorter item as a whole; a document word inside any
occurrence of a window is hit. Defined results: null texts have no words; items without words have no
windows; repeated item rows count once; the windows of a null item_id hit but name no item; other
columns are carried along; empty tables give no rows, an empty benchmark no hits.
"""

from __future__ import annotations

import re
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import checkpoint

#: Bytes of words as they are (A-Z lower-cased), all others as a space.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Words of items in one automaton, some 100 MB at most; more items take further passes over the documents,
#: one after the other, each in a stage of its own.
GROUP_WORDS = 100_000
#: The automaton that this worker built last, by the name of its group.
_BUILT: dict = {}
SPAN = T.ArrayType(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())]))


def normal(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


class Automaton:
    """All substrings of all items; each state knows its longest string and its suffix link."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.window, self.vocab = window, {}
        self.next, self.link, self.len = [{}], [-1], [0]
        seqs = []
        for name, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in normal(text)]
            if ids:
                seqs.append((name, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self.items: dict[int, set] = {}  # state of a whole window -> items that hold it
        self.short: dict[int, list[tuple]] = {}  # state -> (words, item) of the short items that it spells
        self.least = min([window, *(len(ids) for _, ids in seqs)])
        for name, ids in seqs:
            for i, (v, n) in enumerate(self.walk(ids)):
                if n >= window:
                    self.items.setdefault(self.at_length(v, window), set()).add(name)
                elif i == len(ids) - 1 and len(ids) < window:
                    self.short.setdefault(v, []).append((n, name))

    def _state(self, n, edges, link):
        self.next.append(edges)
        self.link.append(link)
        self.len.append(n)
        return len(self.len) - 1

    def _split(self, p, c):
        """The state that spells the longest string of p followed by c, parted from a longer one."""
        q = self.next[p][c]
        if self.len[q] == self.len[p] + 1:
            return q
        new = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last, c):
        if c in self.next[last]:
            return self._split(last, c)
        cur, p = self._state(self.len[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            self.link[cur] = self._split(p, c)
        return cur

    def walk(self, ids):
        """(state, length) of the longest suffix that some item holds, after each word."""
        nxt, link, size, v, n = self.next, self.link, self.len, 0, 0
        for c in ids:
            while v and c not in nxt[v]:
                v = link[v]
                n = size[v]
            if c in nxt[v]:
                v = nxt[v][c]
                n += 1
            yield v, n

    def at_length(self, v, n):
        while self.len[self.link[v]] >= n:
            v = self.link[v]
        return v

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set, int]:
        """Hit spans of word positions (merged, end exclusive), items with windows there, longest match.

        A word that no item has resets the match, so runs of known words are streamed one by one and
        those shorter than any window are passed over (their lengths count for the longest match only
        where a window could be).
        """
        spans, found, longest = [], set(), 0
        if len(words) < self.least or not self.vocab:
            return spans, found, longest
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        gaps = np.concatenate(([-1], np.flatnonzero(ids < 0), [len(ids)]))
        for k in np.flatnonzero(np.diff(gaps) > self.least):
            lo = int(gaps[k]) + 1
            for i, (v, n) in enumerate(self.walk(ids[lo : int(gaps[k + 1])].tolist()), lo):
                longest = max(longest, n)
                reach = 0
                if n >= self.window:
                    reach = self.window
                    found |= self.items[self.at_length(v, reach)]
                if self.short:
                    s, top = v, n
                    while s > 0:
                        for m, name in self.short.get(s, ()):
                            if m <= top:
                                reach = max(reach, m)
                                found.add(name)
                        s = self.link[s]
                        top = self.len[s]
                if reach:
                    start = i + 1 - reach
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, i + 1])
        return spans, found, longest


def merge(spans):
    out = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return out


def groups(benchmark: DataFrame, bound: int):
    """Lists of (item id, text), each of up to ``bound`` words, read one after the other."""
    part, n = [], 0
    for r in benchmark.select(F.col("item_id").cast("string"), F.encode("text", "UTF-8").alias("text")).toLocalIterator():
        size = len(normal(r.text))
        if part and n + size > bound:
            yield part
            part, n = [], 0
        if size:
            part.append((r.item_id, bytes(r.text)))
            n += size
    yield part


def built(name: str, items: list, window: int) -> Automaton:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Automaton(items, window)
    return _BUILT[name]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep=None, group_words: int = GROUP_WORDS) -> DataFrame:
    """Columns ``keep`` of docs (all by default), then n_words, hits (spans of word positions), spans
    (the same in code points), items (ids with occurring windows) and longest (longest match)."""
    keep = docs.columns if keep is None else keep
    own = [T.StructField("__text", T.StringType()), T.StructField("__n", T.IntegerType()), T.StructField("__hits", SPAN), T.StructField("__spans", SPAN), T.StructField("__items", T.ArrayType(T.StringType())), T.StructField("__longest", T.IntegerType())]
    schema = T.StructType([*docs.select(*keep).schema.fields, *own])
    empty = [F.lit(0), F.array().cast(SPAN), F.array().cast(SPAN), F.array().cast("array<string>"), F.lit(0)]
    df = docs.select(*keep, F.col("text").alias("__text"), *(e.alias(f.name) for e, f in zip(empty, own[1:])))
    for i, part in enumerate(groups(benchmark, group_words)):
        if i:  # else passes would be stacked in one stage, each with its worker and automaton
            df = checkpoint(df)
        sent = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches, sent=sent, name=uuid.uuid4().hex):
            automaton = built(name, sent.value, window)
            for b in batches:
                k = len(keep)
                texts = b.column(k).cast(pa.binary())
                ns, hits, chars, items, longest = [], [], [], [], []
                old = [b.column(k + 2).to_pylist(), b.column(k + 3).to_pylist(), b.column(k + 4).to_pylist(), b.column(k + 5).to_pylist()]
                for i, t in enumerate(texts):
                    t = t.as_py()
                    w = normal(t)
                    got, found, most = automaton.scan(w)
                    was = [[s["lo"], s["hi"]] for s in old[0][i]]
                    if got:
                        got = merge(got + was)
                        at = [(m.start(), m.end()) for m in WORD.finditer(t.decode())]
                        chars.append([{"lo": at[lo][0], "hi": at[hi - 1][1]} for lo, hi in got])
                    else:
                        got = was
                        chars.append(old[1][i])
                    ns.append(len(w))
                    hits.append([{"lo": lo, "hi": hi} for lo, hi in got])
                    items.append(sorted(set(old[2][i]) | {x for x in found if x is not None}))
                    longest.append(max(most, old[3][i]))
                span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[: k + 1], pa.array(ns, pa.int32()), pa.array(hits, span), pa.array(chars, span), pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int32())],
                    names=[f.name for f in schema],
                )

        df = df.mapInArrow(run, schema)
    names = ["n_words", "hits", "spans", "items", "longest"]
    return df.select(*keep, *(F.col(f.name).alias(n) for f, n in zip(own[1:], names)))


def n_hit(hits="hits"):
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """docs without what the benchmark also holds: hit spans are cut out of the texts (n_chars, where
    there is one, follows), and documents of whose words more than max_coverage are hit go."""
    own = {"n_words", "hits", "spans", "items", "longest"}
    safe = {c: f"__doc_{c}" if c in own else c for c in docs.columns}
    found = scan(docs.withColumnsRenamed(safe), benchmark, window).where(n_hit() <= F.lit(max_coverage) * F.col("n_words"))
    kept = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, x: F.struct(F.concat(s["out"], F.substring("text", s["at"] + 1, x["lo"] - s["at"]), F.lit(" ")).alias("out"), x["hi"].alias("at")),
        lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))),
    )
    clean = found.withColumn("__cut", F.size("spans") > 0).withColumn("text", F.when(F.col("__cut"), kept).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("__cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.select(*(F.col(safe[c]).alias(c) for c in docs.columns))
