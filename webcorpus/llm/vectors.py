"""Vectors as matrices: Arrow lists to padded rows, blocks of rows as binary columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def width(df: DataFrame, column: str) -> int:
    """Components of the longest vector (0 for an empty table)."""
    return max(0, df.agg(F.max(F.size(column))).first()[0] or 0)


def matrix(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``dim`` doubles, shorter vectors filled with zeros; which rows are vectors of finite components only."""
    lists = lists.cast(pa.list_(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(lists.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), lengths)
    out = np.zeros((len(lists), dim))
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    bad = np.bincount(row[~np.isfinite(flat)], minlength=len(lists)) > 0
    return out, ~bad & lists.is_valid().to_numpy(zero_copy_only=False)


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in the same directions; the largest component is taken out first, so nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def binary_rows(x: np.ndarray) -> pa.Array:
    """Each row's bytes as one binary value."""
    x = np.ascontiguousarray(x)
    step = x.shape[1] * x.itemsize
    offsets = np.arange(len(x) + 1, dtype=np.int64) * step
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)]).cast(pa.binary())


def rows_of(blobs: pa.Array, dtype, dim: int) -> np.ndarray:
    """The inverse of ``binary_rows`` for values without nulls."""
    if isinstance(blobs, pa.ChunkedArray):
        blobs = pa.chunked_array(blobs).combine_chunks()
    return np.frombuffer(b"".join(blobs.to_pylist()), dtype).reshape(-1, dim)


def part(key: str, n: Column | int) -> Column:
    """A number below ``n`` from a hash of the key."""
    return F.pmod(F.xxhash64(key), n if isinstance(n, Column) else F.lit(n)).cast("int")
