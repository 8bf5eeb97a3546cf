"""Vectors: which take part, and unit rows in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of vectors that are not null, empty or zero and hold no null or non-finite component."""
    v = F.col(col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return out.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))


def matrix(column) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(x, np.float64) for x in column.to_numpy(zero_copy_only=False)])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that squares neither overflow nor vanish."""
    if not len(x):
        return x
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
