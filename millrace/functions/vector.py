"""Vector functions over array columns. Everything but the codecs is a JVM expression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _d(v) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def literal(values) -> Column:
    return F.lit([float(x) for x in values])


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_d(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a, b, lenient: bool = False) -> Column:
    """Cosine similarity. Vectors of unequal length raise an error, and a zero vector gives NaN;
    if lenient both give 0."""
    n = norm(a) * norm(b)
    sim = F.when(n == 0, F.lit(0.0 if lenient else float("nan"))).otherwise(dot(a, b) / F.when(n == 0, 1.0).otherwise(n))
    same = F.size(a) == F.size(b)
    other = F.lit(0.0) if lenient else F.raise_error(F.lit("vectors differ in length")).cast("double")
    return F.when(same, sim).otherwise(other)


def l2_normalize(v) -> Column:
    """v by its length; NaN for a zero vector."""
    n = norm(v)
    return F.transform(_d(v), lambda x: F.when(n == 0, F.lit(float("nan"))).otherwise(x / F.when(n == 0, 1.0).otherwise(n)))


def checked(v, size: int) -> Column:
    """v as floats; an error unless it has ``size`` elements."""
    v = F.col(v) if isinstance(v, str) else v
    return F.when(F.size(v) == size, v.cast("array<float>")).otherwise(F.raise_error(F.lit(f"expected {size} dimensions")).cast("array<float>"))


def concatenated(vectors) -> Column:
    """Several vectors, as one response has them, as one."""
    return F.flatten(F.col(vectors) if isinstance(vectors, str) else vectors)


def _codec(dtype: str, element):
    @F.pandas_udf(T.BinaryType())
    def encode(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, dtype=dtype).tobytes())

    @F.pandas_udf(T.ArrayType(element))
    def decode(b: pd.Series) -> pd.Series:
        size = np.dtype(dtype).itemsize
        return b.map(lambda x: None if x is None else np.frombuffer(x[: len(x) // size * size], dtype=dtype))

    return encode, decode


#: Little-endian blobs of float64 and float32; trailing bytes that are no whole number are left out.
to_blob, from_blob = _codec("<f8", T.DoubleType())
to_blob32, from_blob32 = _codec("<f4", T.FloatType())


def mock_embedding(key, size: int, seed: int = 0) -> Column:
    """A vector in [-1, 1) drawn from a hash of key: the same in every run."""
    key = F.col(key) if isinstance(key, str) else key
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.pmod(F.xxhash64(F.lit(seed), key, i), F.lit(2_000_000)) / 1_000_000 - 1)
