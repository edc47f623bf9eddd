"""Whole-number vectors: exact distances, sums and floors that the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components from here on have no place in 64-bit sums and differences.
LARGEST = 2.0**62


def whole_vectors(vectors: DataFrame, scale: int, vector: str, *others: str) -> DataFrame:
    """The columns `others` and v, the components floor(scale * x) as longs, of rows whose vector has components, none
    of them null or non-finite. A component of 2^62 or more is an error."""
    x = F.transform(vector, lambda e: e.cast("double"))
    usable = F.coalesce((F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))

    def component(e: Column) -> Column:
        too_large = F.raise_error(F.lit("a component of a vector is too large for exact 64-bit arithmetic")).cast("long")
        return F.when(F.abs(e * scale) < LARGEST, F.floor(e * scale)).otherwise(too_large)

    return vectors.filter(usable).select(*others, F.transform(x, component).alias("v"))


def matrix(column: pa.ListArray, length: int) -> np.ndarray:
    """The rows of an Arrow column of lists of one length, as int64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), length)


def largest(m: np.ndarray) -> int:
    return max(int(m.max(initial=0)), -int(m.min(initial=0)))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b, exact at every size: |a|^2 - 2ab + |b|^2.

    Products are those of doubles while these hold them exactly, then of 64-bit integers, then of Python's.
    """
    bound = a.shape[1] * (largest(a) + largest(b)) ** 2
    kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object
    x, y = a.astype(kind), b.astype(kind)
    out = (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]
    return out if kind is object else out.astype(np.int64)


def as_longs(distances: np.ndarray) -> np.ndarray:
    """Distances as 64-bit numbers; an error where one doesn't fit."""
    if distances.dtype == object and any(d >= 2**63 for d in distances.ravel()):
        raise OverflowError("a squared distance does not fit in 64 bits")
    return distances.astype(np.int64)


def floor_mean(sums: list[int], n: int) -> list[int]:
    return [s // n for s in sums]
