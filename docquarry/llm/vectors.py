"""What the operators on vectors share: sound rows, matrices of Arrow columns, k-means of bounded memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows of which products are formed at a time.
SLICE = 4096


def finite(vector: str) -> Column:
    """True if the vector is not null and holds neither null nor non-finite entries."""
    return F.col(vector).isNotNull() & F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def nonzero(vector: str) -> Column:
    return F.coalesce(F.exists(vector, lambda v: v != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The number of the centroid of least distance for each row."""
    half = (c * c).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *((x[a : a + SLICE] @ c.T - half).argmax(1) for a in range(0, len(x), SLICE))])


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly spread rows: deterministic, a slice of products at a time."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = nearest(x, c)
        order = np.argsort(home, kind="stable")
        there, starts, size = np.unique(home[order], return_index=True, return_counts=True)
        c[there] = np.add.reduceat(x[order], starts, axis=0) / size[:, None]
    return c
