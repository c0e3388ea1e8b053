"""Vector columns: norms, dot products and cosine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def l2_norm(vector: Column) -> Column:
    zero = F.lit(0.0)
    return F.sqrt(F.aggregate(vector, zero, lambda s, x: s + x.cast("double") * x.cast("double")))


def sparse_cosine(dot: Column, left_norm: Column, right_norm: Column) -> Column:
    """Cosine in 0..1; a zero vector scores 0."""
    raw = dot / F.nullif(left_norm * right_norm, F.lit(0.0))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), F.lit(0.0))


def rrf_display(k: int, full_text_rank: Column, semantic_rank: Column) -> Column:
    """Fused score of two optional 1-based ranks, scaled so two first places give 1."""
    if k < 1:
        raise ValueError("k must be at least 1")

    def share(rank: Column) -> Column:
        checked = F.when(rank < 1, F.raise_error(F.lit("rank must be at least 1")).cast("double")) \
            .otherwise(F.lit(1.0) / (F.lit(float(k)) + rank))
        return F.coalesce(checked, F.lit(0.0))

    return F.least(F.lit(1.0), (share(full_text_rank) + share(semantic_rank)) * ((k + 1) / 2.0))


@F.pandas_udf(DoubleType())
def dense_cosine(left: pd.Series, right: pd.Series) -> pd.Series:
    """Cosine of paired dense vectors in doubles, in -1..1; zero vectors score 0, corrupt ones fail."""
    if len(left) == 0:
        return pd.Series([], dtype="float64")
    sizes = left.map(len).to_numpy()
    if (sizes != right.map(len).to_numpy()).any():
        raise ValueError("vectors of different dimension")
    result = np.zeros(len(left))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        a = np.stack(left.iloc[rows].to_list()).astype("float64")
        b = np.stack(right.iloc[rows].to_list()).astype("float64")
        if not (np.isfinite(a).all() and np.isfinite(b).all()):
            raise ValueError("a vector holds a value that is not finite")
        norms = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
        dots = (a * b).sum(1)
        result[rows] = np.clip(np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0), -1, 1)
    return pd.Series(result)
