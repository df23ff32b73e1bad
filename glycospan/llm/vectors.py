"""Helpers of the vector operators: finite vectors, and their whole-number form packed into bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KINDS = (np.int8, np.int16, np.int32, np.int64)


def vectors_of(df: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """The id, the vector as doubles and further columns under names that cannot clash with others."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("vector"),
        *(F.col(f"`{c}`").alias(f"more_{i}") for i, c in enumerate(more)),
    )


def finite(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the vectors of each length; null vectors and those with null or
    non-finite entries are left out."""
    ok = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    owners = pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
    ok[owners[~np.isfinite(values)]] = False
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths[ok]):
        rows = np.flatnonzero(ok & (lengths == length))
        yield rows, values[starts[rows][:, None] + np.arange(length)]


def floors(matrix: np.ndarray, scale: int, most: int) -> np.ndarray:
    """floor(scale * c) of each entry, held between -most and most."""
    return np.clip(np.floor(matrix * scale), -float(most), float(most)).astype(np.int64)


def packed(whole: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(row numbers, bytes) of the rows: one byte for the width, then the numbers in the narrowest
    width that holds all of the row, so equal rows have equal bytes."""
    width = np.zeros(len(whole), np.int64)
    if whole.shape[1]:
        low, high = whole.min(axis=1), whole.max(axis=1)
        for kind in _KINDS[:-1]:
            width += (low < np.iinfo(kind).min) | (high > np.iinfo(kind).max)
    for code in np.unique(width):
        rows = np.flatnonzero(width == code)
        body = np.ascontiguousarray(whole[rows].astype(_KINDS[code])).view(np.uint8).reshape(len(rows), -1)
        flat = np.hstack([np.full((len(rows), 1), code, np.uint8), body])
        fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(flat.shape[1]), len(rows), [None, pa.py_buffer(flat.tobytes())])
        yield rows, fixed.cast(pa.binary())


def unpacked(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of whole numbers) of packed vectors, by length and width."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    codes = data[starts] if len(sizes) else sizes
    for code, size in sorted(set(zip(codes.tolist(), sizes.tolist(), strict=True))):
        rows = np.flatnonzero((codes == code) & (sizes == size))
        body = np.ascontiguousarray(data[starts[rows][:, None] + np.arange(1, size)])
        yield rows, (body.view(_KINDS[code]) if size > 1 else body).astype(np.int64).reshape(len(rows), -1)
