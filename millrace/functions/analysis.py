"""Tokens for search: unicode letters and digits in lower case, optionally folded or stemmed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{L}\p{N}]+"
#: Letters with marks and the plain letters that fold=True puts in their place.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
#: English words that the scored match query leaves out.
ENGLISH = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def tokens(text, fold: bool = False, stem: bool = False, drop=()) -> Column:
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    out = F.regexp_extract_all(F.coalesce(F.translate(t, MARKED, PLAIN) if fold else t, F.lit("")), F.lit(TOKEN), F.lit(0))
    if drop:
        out = F.filter(out, lambda w: ~w.isin(list(drop)))
    return stems(out) if stem else out


def _measure(w: str) -> tuple[int, str]:
    """Number of vowel-consonant turns, and the pattern of vowels and consonants."""
    kinds = ""
    for i, c in enumerate(w):
        kinds += "v" if c in "aeiou" or c == "y" and i and kinds[-1] == "c" else "c"
    return kinds.count("vc"), kinds


def _ends_cvc(w: str) -> bool:
    return len(w) > 2 and _measure(w)[1][-3:] == "cvc" and w[-1] not in "wxy"


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _measure(w)[1][-1] == "c"


#: Suffixes of the second, third and fourth step of Porter's algorithm (1980).
STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def stem(w: str) -> str:
    """Porter's stem of a lower-case word; words of one or two letters, or of other letters, stay."""
    if len(w) < 3 or not (w.isascii() and w.isalpha()):
        return w
    m = lambda s: _measure(s)[0]
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if "v" in _measure(w[: -len(end)])[1]:
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif _double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif m(w) == 1 and _ends_cvc(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in _measure(w[:-1])[1]:
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        end = max((s for s in table if w.endswith(s)), key=len, default=None)
        if end and m(w[: -len(end)]):
            w = w[: -len(end)] + table[end]
    end = max((s for s in STEP4 if w.endswith(s)), key=len, default=None)
    if end and m(w[: -len(end)]) > 1 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (m(w[:-1]) > 1 or m(w[:-1]) == 1 and not _ends_cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and m(w) > 1:
        w = w[:-1]
    return w


@F.arrow_udf(T.ArrayType(T.StringType()))
def stems(tokens: pa.Array) -> pa.Array:
    """Stems of lists of words: a batch's different words only become Python strings."""
    words = tokens.flatten().dictionary_encode()
    known = pa.array([None if w is None else stem(w) for w in words.dictionary.to_pylist()], pa.string())
    ends = np.cumsum(tokens.value_lengths().fill_null(0).to_numpy())
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), known.take(words.indices), mask=tokens.is_null())
