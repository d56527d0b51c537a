"""Vector functions: Column expressions for one vector a row, NumPy kernels for blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def usable(v: Column) -> Column:
    """Not null, not empty, finite and not zero."""
    n = norm(v)
    return v.isNotNull() & (F.size(v) > 0) & (n > 0) & (n < float("inf")) & ~F.isnan(n)


def unit(v: Column) -> Column:
    """The vector of length one; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def score_of_cosine(cos: Column) -> Column:
    """1 / (1 + squared distance) of vectors of length one."""
    return 1 / (3 - 2 * cos)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def matrix(values, width: int | None = None) -> np.ndarray:
    """A column of equally long Arrow lists as a float64 matrix."""
    parts = [values] if not hasattr(values, "chunks") else values.chunks
    rows = [np.asarray(p.flatten(), dtype=np.float64).reshape(len(p), -1) for p in parts if len(p)]
    return np.concatenate(rows) if rows else np.empty((0, width or 1))


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def best_by_id(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column): each row's ``k`` largest values, of equal ones those of the first columns. Order columns by id for the smaller id to win.

    Values are compared to twelve places, so that products of equal vectors are equal. Minus infinity is never picked.
    """
    s = np.round(s, 12)
    m = min(k, s.shape[1])
    if not m or not len(s):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    least = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m, None]
    take = (s >= least) & np.isfinite(s)
    tied = np.flatnonzero(take.sum(axis=1) > m)
    if len(tied):
        t, edge = s[tied], least[tied]
        over, even = t > edge, t == edge
        take[tied] = over | even & (np.cumsum(even, axis=1) <= m - over.sum(axis=1, keepdims=True))
    return np.nonzero(take)
