"""Vectors as Spark rows: validity, packing into bytes, copies, magnitudes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, vec)`` of vectors that take part, ``vec`` the components as little-endian doubles.

    Left out: null ids, and vectors that are null, empty, zero or hold null or
    non-finite components. Negative zeros become zeros.
    """

    def run(batches):
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not v or None in v:
                    continue
                x = np.asarray(v, "<f8") + 0.0
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    return vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")).mapInArrow(run, "vec_id long, vec binary")


def same_length(rows: DataFrame, vec: str = "vec") -> int:
    """Number of components of the vectors (0 if there are none); unequal lengths are refused."""
    low, high = rows.agg(F.min(F.octet_length(vec)), F.max(F.octet_length(vec))).first()
    if low != high:
        raise ValueError(f"vectors of unequal length: {low // 8} to {high // 8} components")
    return (low or 0) // 8


def matrix(column, dims: int | None = None) -> np.ndarray:
    """Rows of packed doubles as a matrix."""
    values = column.to_pylist() if hasattr(column, "to_pylist") else list(column)
    if not values:
        return np.empty((0, dims or 0))
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1)


def exponents(x: np.ndarray) -> np.ndarray:
    """Binary exponent of the largest component of each row."""
    return np.frexp(np.abs(x).max(1, initial=0.0))[1].astype(np.int64)


def shifted(x: np.ndarray, by: np.ndarray | int) -> np.ndarray:
    """Rows times a power of two: exact unless components fall below the smallest double."""
    by = np.broadcast_to(np.asarray(by, np.int64), (len(x),))
    half = by // 2  # 2**-1074 to 2**1023 needs two steps
    return np.ldexp(np.ldexp(x, half[:, None].astype(np.int32)), (by - half)[:, None].astype(np.int32))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one, whatever their magnitude."""
    y = shifted(x, -exponents(x))
    return y / np.sqrt((y**2).sum(1, keepdims=True))


def finite_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list column: which rows have components, none of them null or non-finite; their lengths; all components one after another."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)  # nulls become NaN
    bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
    edge = np.r_[0, np.cumsum(lengths)]
    return (lengths > 0) & (bad[edge[1:]] == bad[edge[:-1]]), lengths, flat


def narrow(x: np.ndarray) -> list[bytes]:
    """Integer rows packed at the narrowest of 1, 2, 4 or 8 bytes a component, which a first byte names; equal rows have equal bytes."""
    width = np.full(len(x), 8)
    for w in (4, 2, 1):
        top = 1 << (8 * w - 1)
        width[((x >= -top) & (x < top)).all(1)] = w
    out: list[bytes] = [b""] * len(x)
    for w in (1, 2, 4, 8):
        rows = np.flatnonzero(width == w)
        mark = bytes([w])
        for i, row in zip(rows.tolist(), x[rows].astype(f"<i{w}")):
            out[i] = mark + row.tobytes()
    return out


def wide(column) -> np.ndarray:
    """Rows of :func:`narrow`, all of one length, as a matrix of 64-bit integers."""
    values = column.to_pylist() if hasattr(column, "to_pylist") else list(column)
    if not values:
        return np.empty((0, 0), np.int64)
    out = np.empty((len(values), (len(values[0]) - 1) // values[0][0]), np.int64)
    width = np.array([v[0] for v in values])
    for w in (1, 2, 4, 8):
        rows = np.flatnonzero(width == w)
        if len(rows):
            out[rows] = np.frombuffer(b"".join([values[i][1:] for i in rows.tolist()]), f"<i{w}").reshape(len(rows), -1)
    return out


#: Bits of a limb: sums over many partitions of integers of any size stay exact in three columns.
LIMB = 42


def limbs(values) -> list[list[int]]:
    """Python integers as three columns, the lower two without sign."""
    mask = (1 << LIMB) - 1
    return [[v >> 2 * LIMB for v in values], [(v >> LIMB) & mask for v in values], [v & mask for v in values]]


LIMBS = "high long, middle long, low long"


def summed(rows: DataFrame, *keys: str) -> dict[tuple, int]:
    """Exact sums of the limbs of each key, of which there are few."""
    total = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "middle", "low")]
    return {tuple(r[k] for k in keys): (int(r["high"]) << 2 * LIMB) + (int(r["middle"]) << LIMB) + int(r["low"]) for r in rows.groupBy(*keys).agg(*total).collect()}


def gram(y: np.ndarray) -> np.ndarray:
    """Exact ``y' y`` of integer rows, as Python integers where 64 bits do not hold it."""
    top = int(np.abs(y).max(initial=0))
    if len(y) * top * top < 1 << 53:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64)
    if len(y) * top * top < 1 << 62:
        return y.T @ y
    big = y.astype(object)
    return big.T @ big
