"""Vectors of a table as the vector operators take them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite_vectors(df: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and ``x`` array<double>: rows whose embedding is not null and holds only finite components."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return df.where(F.col("embedding").isNotNull()).select(*keep, x.alias("x")).where(~bad)


def matrix(column: pa.Array, dim: int, kind=np.float64) -> np.ndarray:
    """The vectors of a batch as rows, shorter ones filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if (lengths == dim).all():
        return flat.reshape(-1, dim) if dim else np.zeros((len(lengths), 0), kind)
    out = np.zeros((len(lengths), dim), kind)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    for i, n in enumerate(lengths):
        out[i, :n] = flat[begins[i] : begins[i] + n]
    return out
