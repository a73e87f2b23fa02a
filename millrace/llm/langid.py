"""Language identification of words by a linear-chain conditional random field.

Every word is labelled by forward-backward over the whole text as one chain; its emission score is a
sum of learned weights of hashed features: character n-grams, affixes (n-grams that hold a word
boundary) and the lexicon entry (the whole word). Transitions are learned from spliced, code-switched
training sequences. A document takes the label with the largest expected share of its words.

Defined results: a text that is null or has no letter is ``und`` with score 0; without any labelled
training row every document is ``und``; ties go to the label that sorts first; repeated rows each get
their row, of different texts with one doc_id and lang the least is learned from; a null doc_id is neither
held out nor learned from; other columns are ignored by ``predict`` unless asked for; an empty table gives
no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import slices

#: ASCII letters and all non-ASCII bytes stay, the rest separates words (texts are lower-cased before).
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
ASCII = bytes(c for c in range(256) if 97 <= c <= 122)
#: Words of a chain that are run through at a time (all, with over MOST labels); runs are joined exactly.
SEQ, MOST = 128, 32
#: Features are hashed to this many rows of weights.
ROWS = 1 << 16
GRAMS = (2, 3, 4)
#: Bounds of the training sample: documents in all, and words taken from them.
TRAIN_DOCS, TRAIN_WORDS = 1600, 400_000
#: Of a training text with more code points than PARTS * PART, that many evenly spaced parts are read.
PARTS, PART = 64, 1024
CACHE = 400_000


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words of letters; words without any letter don't count."""
    if not text:
        return []
    w = text.lower().encode("utf-8", "replace").translate(LETTERS).split()
    return [x for x in w if x[0] < 128 or has_letter(x)]


def has_letter(word: bytes) -> bool:
    return bool(word.translate(None, bytes(range(128, 256)))) or any(c.isalpha() for c in word.decode("utf-8", "replace"))


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature rows of the words, word by word, and where each word's begin."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    x = np.frombuffer(b"^" + b"$^".join(words) + b"$", dtype=np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    rows, owners = [np.fromiter((zlib.crc32(w) for w in words), dtype=np.uint64, count=len(words)) & np.uint64(ROWS - 1)], [np.arange(len(words))]
    h = x.copy()
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * np.uint64(1_000_003) + x[n - 1 :] + np.uint64(n)
        if n in GRAMS:
            whole = owner[: len(h)] == owner[n - 1 :]
            mixed = h[whole] * np.uint64(0x9E3779B97F4A7C15)
            rows.append(mixed >> np.uint64(64 - ROWS.bit_length() + 1))
            owners.append(owner[: len(h)][whole])
    rows, owners = np.concatenate(rows).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return rows[order], np.searchsorted(owners[order], np.arange(len(words)))


def emissions(weights: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Scores of each label for each word, on a scale whose best is 1 (exponentials)."""
    rows, starts = features(words)
    s = np.add.reduceat(weights[rows], starts, axis=0)
    return np.exp(np.maximum(s - s.max(axis=1, keepdims=True), -30)).astype(np.float32)


def forward_backward(e: np.ndarray, starts: np.ndarray, sizes: np.ndarray, trans: np.ndarray, first: np.ndarray, last: np.ndarray | None = None):
    """Posterior of each label at each position of the sequences e[start : start + size], and, for the
    trainer, pair posteriors summed over all neighbours. first and last weigh the labels at either end,
    for all sequences or for each."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    first = np.broadcast_to(first, (len(order), e.shape[1]))[order]
    last = (np.ones(first.shape, e.dtype) if last is None else last)[order]
    most = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, most + 1), side="right")
    alpha, a = np.empty_like(e), None
    for t in range(most):
        at = starts[: active[t]] + t
        a = (first if t == 0 else a[: active[t]] @ trans) * e[at]
        a /= a.sum(axis=1, keepdims=True)
        alpha[at] = a
    post, pairs, beta = np.empty_like(e), np.zeros_like(trans, dtype=np.float64), None
    for t in range(most - 1, -1, -1):
        at = starts[: active[t]] + t
        b = last[: active[t]].copy()
        if beta is not None:
            k = len(beta)
            seen = e[at[:k] + 1] * beta
            b[:k] = seen @ trans.T
            scale = (alpha[at[:k]] * b[:k]).sum(axis=1, keepdims=True)
            pairs += trans * (alpha[at[:k]].T @ (seen / scale))
            b[:k] /= b[:k].sum(axis=1, keepdims=True)
        p = alpha[at] * b
        post[at] = p / p.sum(axis=1, keepdims=True)
        beta = b
    return post, pairs


def transfers(e: np.ndarray, starts: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """For each run, the weight of all its labellings by first and last label (up to a factor)."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    m = np.eye(len(trans), dtype=e.dtype) * e[starts][:, None, :]
    for t in range(1, int(sizes[0])):
        n = int(np.searchsorted(-sizes, -t, side="left"))
        x = (m[:n] @ trans) * e[starts[:n] + t][:, None, :]
        m[:n] = x / x.max(axis=(1, 2), keepdims=True)
    out = np.empty_like(m)
    out[order] = m
    return out


def posteriors(e: np.ndarray, sizes: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Posterior of each label at each position of the consecutive chains of the given sizes (none is 0).

    Long chains are run through in runs of SEQ words, side by side: what comes into a run from the left
    and from the right follows from the transfer matrices of the runs before and after it.
    """
    step = SEQ if len(trans) <= MOST else int(sizes.max())
    n = -(-sizes // step)
    begins, base, of = np.cumsum(sizes) - sizes, np.cumsum(n) - n, np.repeat(np.arange(len(sizes)), n)
    starts = begins[of] + (np.arange(len(of)) - base[of]) * step
    lengths = np.minimum(step, (begins + sizes)[of] - starts)
    enter, leave = np.tile(first.astype(e.dtype), (len(of), 1)), np.ones((len(of), len(trans)), e.dtype)
    if n.max() > 1:
        many = np.flatnonzero(n[of] > 1)
        at = np.zeros(len(of), np.int64)
        at[many] = np.arange(len(many))
        m = transfers(e, starts[many], lengths[many], trans)
        for j in range(1, int(n.max())):
            r = base[n > j] + j
            x = np.einsum("ij,ijk->ik", enter[r - 1], m[at[r - 1]]) @ trans
            enter[r] = x / x.sum(axis=1, keepdims=True)
        for j in range(int(n.max()) - 2, -1, -1):
            r = base[n > j + 1] + j
            x = np.einsum("ijk,ik->ij", m[at[r + 1]], leave[r + 1]) @ trans.T
            leave[r] = x / x.sum(axis=1, keepdims=True)
    return forward_backward(e, starts, lengths, trans, enter, leave)[0]


def levelled(sizes: list[int], total: int) -> list[int]:
    """Shares of ``total``, as even as sizes allow: what one leaves the others have."""
    out, left = [0] * len(sizes), total
    for rank, i in enumerate(sorted(range(len(sizes)), key=lambda i: (sizes[i], i))):
        out[i] = min(sizes[i], left // (len(sizes) - rank))
        left -= out[i]
    return out


def budgets(sizes: list[int], of: list[str]) -> list[int]:
    """Words to take of each document: TRAIN_WORDS evenly over the labels, and a label's over its documents."""
    each = {y: [i for i, x in enumerate(of) if x == y] for y in sorted(set(of))}
    out = [0] * len(sizes)
    for at, share in zip(each.values(), levelled([sum(sizes[i] for i in at) for at in each.values()], TRAIN_WORDS)):
        for i, n in zip(at, levelled([sizes[i] for i in at], share)):
            out[i] = n
    return out


def spread(words: list, n: int) -> list:
    """n of the words, in runs of about 24 at even distances over the whole text."""
    if n >= len(words):
        return words
    m, out = -(-n // 24), []
    for j in range(m):
        skipped = j * (len(words) - n) // m
        out += words[j * n // m + skipped : (j + 1) * n // m + skipped]
    return out


def train(rows: list[tuple[str, str]], labels: list[str], steps: int = 25, seed: int = 7) -> dict:
    """Weights, transitions and first-label scores from (text, label) rows, by Adam on the regularised
    log-likelihood of spliced sequences (runs of 1 to 24 words from random documents)."""
    rng, k = np.random.default_rng(seed), len(labels)
    vocab, runs = {}, []
    sizes = [len(tokens(text)) for text, _ in rows]
    for (text, label), n in zip(rows, budgets(sizes, [label for _, label in rows])):
        ids = [vocab.setdefault(x, len(vocab)) for x in spread(tokens(text), n)]
        y, at = labels.index(label), 0
        while at < len(ids):
            n = int(rng.integers(1, 25))
            runs.append((ids[at : at + n], y))
            at += n
    if not runs:
        return {"labels": []}
    rng.shuffle(runs)
    ids = np.array([i for r, _ in runs for i in r])
    gold = np.array([y for r, y in runs for _ in r])
    starts = np.arange(0, len(ids), 32)
    sizes = np.minimum(32, len(ids) - starts)
    inner = np.ones(len(ids), bool)
    inner[starts] = False
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
    begun = np.bincount(gold[starts], minlength=k)
    feats, at = features(list(vocab))
    counts = np.diff(np.append(at, len(feats)))
    truth = np.zeros((len(vocab), k))
    np.add.at(truth, (ids, gold), 1)
    n = len(ids)
    params = [np.zeros((ROWS, k)), np.zeros((k, k)), np.zeros(k)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        s = np.add.reduceat(params[0][feats], at, axis=0)
        e = np.exp(np.maximum(s - s.max(axis=1, keepdims=True), -30))[ids]
        post, pairs = forward_backward(e, starts, sizes, np.exp(params[1]), np.exp(params[2]))
        off = np.stack([np.bincount(ids, weights=post[:, j], minlength=len(vocab)) for j in range(k)], axis=1) - truth
        grads = [np.stack([np.bincount(feats, weights=np.repeat(off[:, j], counts), minlength=ROWS) for j in range(k)], axis=1), pairs - seen, post[starts].sum(axis=0) - begun]
        for i, g in enumerate(grads):
            g = g / n + 1e-6 * params[i]
            m, v = moments[i] = (0.9 * moments[i][0] + 0.1 * g, 0.99 * moments[i][1] + 0.01 * g * g)
            params[i] = params[i] - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return {"labels": labels, "weights": params[0].astype(np.float32), "trans": np.exp(params[1]).astype(np.float32), "first": np.exp(params[2]).astype(np.float32)}


class Labeller:
    """Labels batches of texts; scores of words that recur are kept, up to CACHE of them."""

    def __init__(self, model: dict):
        self.model, self.rows = model, {}
        self.scores = np.zeros((0, len(model["labels"])), np.float32)

    def shares(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Expected share of each label among the words of each text; None without words."""
        if not self.model["labels"]:
            return [None] * len(texts)
        if len(self.rows) > CACHE:
            self.rows.clear()
            self.scores = self.scores[:0]
        words, sizes, new = [], [], []
        for t in texts:
            w = tokens(t)
            sizes.append(len(w))
            for x in w:
                i = self.rows.get(x)
                if i is None:
                    i = self.rows[x] = len(self.rows)
                    new.append(x)
                words.append(i)
        parts = [emissions(self.model["weights"], new[i : i + 50_000]) for i in range(0, len(new), 50_000)]
        self.scores = np.concatenate([self.scores, *parts])
        if not words:
            return [None] * len(texts)
        e = self.scores[np.array(words)]
        full = [i for i, n in enumerate(sizes) if n]
        some = np.array(sizes)[full]
        post = posteriors(e, some, self.model["trans"], self.model["first"])
        sums = np.add.reduceat(post.astype(np.float64), np.cumsum(some) - some, axis=0)
        out: list = [None] * len(texts)
        for i, s in zip(full, sums):
            out[i] = s / sizes[i]
        return out


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame) -> tuple[list[tuple[str, str]], list[str]]:
    """Training rows, TRAIN_DOCS at most (4 a label if there are more labels than a quarter of that),
    evenly over the labels; and the labels.

    Rows are drawn by a hash of doc_id at a rate that follows from the label's count, so no task orders a
    whole language; the first by hash of those drawn stay.
    """
    may = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out())
    counts = {r.lang: r.n for r in may.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    each, steps = max(4, TRAIN_DOCS // len(counts)), 1 << 30
    rates = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(steps, steps * 3 * each // (2 * n)))))
    drawn = may.where(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < rates[F.col("lang")])
    part = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.substring("text", (i * ((F.length("text") - PART) / (PARTS - 1))).cast("int") + 1, F.lit(PART)))
    text = F.when(F.length("text") > PARTS * PART, F.array_join(part, " ")).otherwise(F.col("text"))
    rows = drawn.groupBy("doc_id", "lang").agg(F.min(text).alias("text")).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), str(r.doc_id), r.lang))
    seen: Counter = Counter()
    out = []
    for r in rows:
        seen[r.lang] += 1
        if seen[r.lang] <= each:
            out.append((r.text, r.lang))
    return out, sorted(counts)


def predict(docs: DataFrame, keep=("doc_id",), model: dict | None = None) -> DataFrame:
    """Columns ``keep`` of docs, then lang_pred, score, n_words (of letters) and n_langs (labels with
    a fifth of the words or more)."""
    model = model or train(*sample(docs))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep).schema.fields
    add = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_langs", T.IntegerType())]

    def run(batches):
        labeller = Labeller(sent.value)
        labels = sent.value["labels"]
        for b in batches:
            texts, names, scores, many = b.column(b.num_columns - 1), [], [], []
            for part in slices(texts):
                for p in labeller.shares(part.to_pylist()):
                    best = None if p is None else int(p.argmax())
                    names.append("und" if p is None else labels[best])
                    scores.append(0.0 if p is None else float(min(1.0, p[best])))
                    many.append(0 if p is None else int((p >= 0.2).sum()))
            arrays = [*b.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(many, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in (*kept, *add)])

    safe = [f"__{i}" for i in range(len(kept))]
    own = docs.select(*(F.col(c).alias(s) for c, s in zip(keep, safe)), F.col("text").alias("__text"))
    out = T.StructType([T.StructField(s, f.dataType) for s, f in zip(safe, kept)] + add)
    done = own.mapInArrow(lambda it: (pa.RecordBatch.from_arrays(b.columns, names=out.names) for b in run(it)), out)
    return done.select(*(F.col(s).alias(c) for s, c in zip(safe, keep)), *(f.name for f in add))


def accepted(docs: DataFrame, least: float = 0.3, model: dict | None = None) -> DataFrame:
    """docs whose language could be told: not ``und``, and the label has a share of ``least`` or more."""
    n = len(docs.columns)
    got = predict(docs, docs.columns, model).toDF(*(f"c{i}" for i in range(n)), "p", "s", "k")
    return got.where((F.col("p") != "und") & (F.col("s") >= least)).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
