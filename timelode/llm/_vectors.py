"""Vectors as exact integers: which rows take part, Arrow lists as matrices, sums that don't overflow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components from here on count as infinite: scaled by 1024 their differences still fit a long, and their squares a decimal of 38 digits.
TOO_LARGE = 2.0**48
LONG = 1 << 63


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers; never null."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < TOO_LARGE)), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column whose lists have one length."""
    n = len(column)
    return np.asarray(column.flatten()).reshape(n, -1) if n else np.zeros((0, 0))


def lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def scaled(vectors: np.ndarray, shift: int = 0) -> np.ndarray:
    """floor(1024 * c) + shift of every component."""
    return np.floor(1024.0 * vectors.astype(np.float64)).astype(np.int64) + shift


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def column_sums(x: np.ndarray) -> np.ndarray:
    """Exact sums of the columns, as Python integers."""
    if largest(x) * len(x) < LONG:
        return x.sum(axis=0).astype(object)
    return x.astype(object).sum(axis=0)


def square_sums(x: np.ndarray) -> np.ndarray:
    """Exact sums of the rows' squares: int64 where they fit, else Python integers."""
    if x.dtype != object and largest(x) ** 2 * x.shape[1] < LONG:
        return (x * x).sum(axis=1)
    wide = x.astype(object)
    return (wide * wide).sum(axis=1)


def longs(values: np.ndarray) -> pa.Array:
    """int64 of exact integers; null where one doesn't fit."""
    return pa.array(values) if values.dtype != object else pa.array([int(v) if abs(v) < LONG else None for v in values], pa.int64())
