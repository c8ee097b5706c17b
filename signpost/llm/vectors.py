"""What the embedding operators share: usable vectors, equal ones together, packed into Arrow tasks."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def is_usable(column: str = "embedding") -> Column:
    """Whether a vector of doubles has finite numbers only, and not only zeros."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(column, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def unit(rows: np.ndarray) -> np.ndarray:
    # Scaled by the greatest component first, so that no square is lost or overflows.
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def dimension(vectors: DataFrame) -> int:
    """The one length of the vectors, 0 if there are none."""
    low, high = vectors.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if low != high:
        raise ValueError(f"vectors have from {low} to {high} components")
    return low or 0
