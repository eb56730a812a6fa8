"""Vectors of an Arrow column as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def finite_rows(column: pa.Array, length: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of doubles) for each length of vector in the column, or the one wanted.

    Null and empty vectors and those that hold a null, NaN or infinite component are left out.
    """
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    # Nulls among the components become NaN; null lists have no components here.
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for n in np.unique(lengths) if length is None else (length,):
        rows = np.flatnonzero(lengths == n)
        if n and len(rows):
            matrix = flat[starts[rows][:, None] + np.arange(n)]
            good = np.isfinite(matrix).all(axis=1)
            if good.any():
                yield rows[good], matrix[good]


def packed(matrix: np.ndarray) -> pa.Array:
    """One binary value per row."""
    matrix = np.ascontiguousarray(matrix)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(matrix.shape[1] * matrix.itemsize), len(matrix), [None, pa.py_buffer(matrix)]).cast(pa.binary())


def unpacked(column: pa.Array, dtype) -> np.ndarray:
    """The rows that ``packed`` made, all of one length."""
    if not len(column):
        return np.zeros((0, 0), dtype=dtype)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), -1)
