"""Vector functions over ``array<float>`` columns, summed in double precision."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def _double(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Over the shorter of the two."""
    n = F.least(F.size(a), F.size(b))
    return _sum(F.zip_with(F.slice(_double(a), 1, n), F.slice(_double(b), 1, n), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(_double(a), lambda x: x * x)))


def cosine_permissive(a: Column, b: Column) -> Column:
    """Cosine over the common length with the norms of the whole vectors; 0 for a zero or null vector."""
    na, nb = norm(a), norm(b)
    return F.coalesce(F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)), F.lit(0.0))


def cosine_strict(a: Column, b: Column) -> Column:
    """Cosine; 0 for vectors of unlike or no length."""
    return F.when(F.coalesce((F.size(a) == F.size(b)) & (F.size(a) > 0), F.lit(False)), cosine_permissive(a, b)).otherwise(0.0)


def literal(vector: list[float]) -> Column:
    return F.lit([float(x) for x in vector]).cast("array<double>")


@F.pandas_udf(ArrayType(FloatType()))
def dummy_embedding(text: pd.Series) -> pd.Series:
    """Offline embedding: a signed bag of hashed words of length 64, unit norm; the zero vector for no words."""
    out = []
    for t in text:
        v = np.zeros(64)
        for w in (t or "").lower().split():
            h = hashlib.sha256(w.encode()).digest()
            v[h[0] % 64] += 1 if h[1] & 1 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).astype("float32").tolist())
    return pd.Series(out)
