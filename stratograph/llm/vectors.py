"""Vectors of a list column as exact integers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Products and sums of numbers below it are exact in double precision.
EXACT = 1 << 53


def limit(dim: int) -> int:
    """Integers up to it have squared distances and inner products that fit a long."""
    return math.isqrt((1 << 62) // (4 * max(1, dim)))


def lengths(column: pa.Array) -> np.ndarray:
    """Numbers in each vector, -1 for a null."""
    return pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def integers(column: pa.Array, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x): floor(scale * component) of the vectors of ``dim`` numbers, and which rows those are.

    Left out are vectors that are null or hold a null, a NaN, an infinity or a number so large
    that its integer is beyond ``limit``."""
    size = lengths(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(np.maximum(size, 0))
    rows = np.flatnonzero(size == dim)
    at = (ends[rows] - dim)[:, None] + np.arange(dim)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(flat[at] * scale)
        good = (np.abs(x) <= limit(dim)).all(axis=1)
    return rows[good], x[good].astype(np.int64)


def narrow(x: np.ndarray) -> np.ndarray:
    """``x`` in the fewest bytes that hold it."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    return x.astype(next(k for k, top in (("<i1", 1 << 7), ("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 63)) if most < top))


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of integers, as longs."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * x.shape[1]
    if most < EXACT:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x.astype(np.int64) @ y.astype(np.int64).T


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two matrices of integers, as longs."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    if 4 * most * most * x.shape[1] < EXACT:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    a, b = x.astype(np.int64), y.astype(np.int64)
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)
