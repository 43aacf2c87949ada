"""Integer vectors from an embedding table, shared by the vector operators."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LARGEST = 1 << 26  # of an integer component: sums of squares then fit into 64 bits


def finite(vector: str) -> Column:
    """The vector is there and all its components are numbers."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def width(vectors: DataFrame, vector: str) -> int:
    """Components of the longest vector; shorter ones count as filled up with zeros."""
    return vectors.where(finite(vector)).agg(F.max(F.size(vector))).first()[0] or 0


def integers(column: pa.Array, scale: int, columns: int) -> np.ndarray:
    """floor(scale * x) of every component, a row for each vector, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), columns))
    out[np.arange(columns) < sizes[:, None]] = flat
    out = np.floor(out * scale)
    if out.size and np.abs(out).max() >= LARGEST:
        raise ValueError(f"a component beyond {LARGEST / scale:g}")
    return out.astype(np.int64)


def exact_in_doubles(*arrays: np.ndarray) -> bool:
    """Sums of products of two rows, or of squared differences, are exact in floating point."""
    top = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    return 4 * top * top * max((a.shape[-1] for a in arrays), default=0) < 1 << 52
