"""Vectors of embeddings as whole numbers: x = floor(256 c), packed into bytes that are equal where the vectors are."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimension(rows: DataFrame, vec_col: str) -> int:
    """The commonest length of a vector (of equally common ones the largest); 0 without any."""
    sizes = rows.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("d")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return int(top["d"]) if top else 0


def matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of length d that hold finite entries only, and their x (int64), saturated like a cast."""
    at = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == d) if d else np.zeros(0, np.int64)
    flat = pc.list_flatten(column.take(pa.array(at))).cast(pa.float64())
    c = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, max(d, 1))
    good = np.isfinite(c).all(axis=1)
    with np.errstate(over="ignore"):
        x = np.floor(256 * c[good])
    return at[good], np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def packed(x: np.ndarray) -> pa.Array:
    """Each row as little-endian bytes of 2, 4 or 8 a number, the fewest that hold the whole row."""
    wide = np.where((x < -(1 << 31)) | (x >= 1 << 31), 8, np.where((x < -(1 << 15)) | (x >= 1 << 15), 4, 2)).max(axis=1, initial=2)
    if (wide == 2).all():
        offsets = np.arange(len(x) + 1, dtype=np.int32) * (2 * x.shape[1])
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x.astype("<i2").tobytes())])
    return pa.array([row.astype(f"<i{w}").tobytes() for row, w in zip(x, wide, strict=True)], pa.binary())


def unpacked(column: pa.Array, d: int) -> np.ndarray:
    """The rows that packed() made (int64)."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), d), dtype=np.int64)
    for w in (2, 4, 8):
        at = np.flatnonzero(size == w * d)
        if len(at):
            out[at] = np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), dtype=f"<i{w}").reshape(-1, d)
    return out
