"""Reading embedding columns: which rows take part, and their numbers as one array."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import quoted


def widest(vectors: DataFrame, column: str = "embedding") -> int:
    return vectors.agg(F.max(F.size(F.col(quoted(column))))).first()[0] or 0


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their float64 matrix).  A vector that is null or holds a null or
    non-finite component takes no part; shorter ones count as if zeros followed."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = column.flatten()
    values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    out = np.zeros((len(column), dim))
    if len(values):
        row = np.repeat(np.arange(len(column)), sizes)
        out[row, np.arange(len(values)) - np.repeat(ends - sizes, sizes)] = values
    fine = np.asarray(column.is_valid()) & np.isfinite(out).all(axis=1)
    return np.flatnonzero(fine), out[fine]
