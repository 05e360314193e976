"""Dense and sparse vector expressions."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(x), doubles(y), lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def unit(x: Column) -> Column:
    """SC5: L2-normalised; a zero vector stays zero."""
    n = norm(x)
    return F.when(n == 0, doubles(x)).otherwise(F.transform(doubles(x), lambda a: a / n))


def cosine(x: Column, y: Column) -> Column:
    """0 where either norm is 0."""
    return F.coalesce(dot(x, y) / F.nullif(norm(x) * norm(y), F.lit(0.0)), F.lit(0.0))


def slot(token: Column, size: int = 256) -> Column:
    """SC6: the hashing vectoriser's slot of a token."""
    return (F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % size).cast("int")


def valid_vector(v: Column, dimension: int) -> Column:
    """SRC10: right length, finite, of unit norm."""
    finite = F.forall(doubles(v), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(v) == dimension) & finite & (F.abs(norm(v) - 1) <= 1e-3)


def mock_embed(dimension: int = 64):
    """SC8: unit Gaussian vectors seeded by the text's SHA-256."""

    @F.pandas_udf("array<float>")
    def embed(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> np.ndarray | None:
            if x is None:
                return None
            v = np.random.default_rng(int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "big")).standard_normal(dimension)
            return (v / np.linalg.norm(v)).astype(np.float32)

        return pd.Series([one(x) for x in s])

    return embed
