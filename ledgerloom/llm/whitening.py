"""Embedding whitening by mixed-precision refinement.

Components are put on an integer grid, so that counts, sums and products are
exact whatever the order in which tasks add them. The covariance of the
distinct grid vectors is summed over partitions after centring; its
eigenvectors are first taken in single precision and then corrected by
Ogita-Aishima iterations, which are matrix products only, in double and at last
in extended precision. Eigenvalues that an iteration cannot tell apart form a
cluster; a small eigenproblem within the span of each cluster separates them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import LIMBS, finite_rows, gram, limbs, narrow, summed, wide

#: Grid steps a unit, and the number added to every component.
GRID, SHIFT = 64, 1_000_000
#: Grid values saturate at this magnitude.
LARGEST = 1 << 61
#: Rows whose products are taken at once.
BLOCK = 4096
#: Corrections at each precision, at most, and the error below which the first that does not halve it is the last.
ROUNDS, SETTLED = 12, 1e-10


def on_grid(vectors: DataFrame, grid: int = GRID) -> DataFrame:
    """``(vec_id, dims, x)`` of the rows that take part; ``x`` the packed ``floor(grid * c)``."""

    def run(batches):
        for batch in batches:
            ok, lengths, flat = finite_rows(batch.column(1))
            edge = np.r_[0, np.cumsum(lengths)]
            with np.errstate(over="ignore"):
                grids = np.clip(np.floor(flat * grid), -float(LARGEST), float(LARGEST))
            rows = np.flatnonzero(ok)
            packed: list[bytes] = [b""] * len(rows)
            for d in np.unique(lengths[rows]).tolist():
                at = np.flatnonzero(lengths[rows] == d)
                x = grids[edge[rows[at]][:, None] + np.arange(d)].astype(np.int64)
                for i, p in zip(at.tolist(), narrow(x)):
                    packed[i] = p
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(lengths[rows], pa.int32()), pa.array(packed, pa.binary())], names=["vec_id", "dims", "x"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, dims int, x binary")


def step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """One correction of approximate eigenvectors ``x`` of ``a``, in the precision of both, and the error they had.

    The error bounds how far ``x`` is from being orthogonal and ``x' a x`` from
    being diagonal. Values nearer to each other than that are a cluster: between
    its vectors only the orthogonality is corrected, and then the cluster's own
    small problem, shifted by its mean, is solved.
    """
    n = len(a)
    r, s = np.eye(n, dtype=a.dtype) - x.T @ x, x.T @ a @ x
    r, s = (r + r.T) / 2, (s + s.T) / 2  # else close values would turn rounding into slant
    values = np.diag(s) / (1 - np.diag(r))
    error = 2 * (np.sqrt(((s - np.diag(values)) ** 2).sum()) + np.sqrt((a**2).sum()) * np.sqrt((r**2).sum()))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > error
    x = x + x @ np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    order = np.argsort(-values, kind="stable")
    edges = [0, *(i for i in range(1, n) if values[order[i - 1]] - values[order[i]] > error), n]
    for low, high in zip(edges, edges[1:]):
        if high - low > 1:
            members = order[low:high]
            q, mean = x[:, members], values[members].mean()
            inner = q.T @ (a @ q) - mean * (q.T @ q)
            size = np.abs(inner).max()
            if size > 0:
                _, w = np.linalg.eigh(((inner + inner.T) / (2 * size)).astype(float))
                w = w[:, ::-1].astype(a.dtype)
                w = w @ (3 * np.eye(len(members), dtype=a.dtype) - w.T @ w) / 2  # orthogonal in this precision too
                x[:, members] = q @ w
    return x, float(error)


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix of extended precision, both rounded to doubles."""
    size = np.abs(a).max(initial=0)
    if not size > 0:
        return np.zeros(len(a)), np.eye(len(a))
    a = a / size
    _, x = np.linalg.eigh(a.astype(np.float32))
    for kind in (np.float64, a.dtype.type):
        b, x, before = a.astype(kind), x.astype(kind), math.inf
        for _ in range(ROUNDS):
            better, error = step(b, x)
            if error <= len(a) ** 1.5 * np.finfo(kind).eps or (error >= before / 2 and error < SETTLED):
                break
            x, before = better, error
    values = np.diag(x.T @ a @ x) / (x**2).sum(0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    x = x / np.sqrt((x**2).sum(0))
    return (values[order] * size).astype(float), x.astype(float)


def totals(fit: DataFrame, of_block, keys: int) -> dict[tuple, int]:
    """Exact sums over all rows of the ``keys`` integers that ``of_block`` takes from the grid vectors of a block."""

    def run(batches):
        whole = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                now = of_block(wide(batch.column(0).slice(at, BLOCK))).astype(object)
                whole = now if whole is None else whole + now
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(keys), pa.int32()), *[pa.array(c, pa.int64()) for c in limbs(whole.tolist())]], names=["i", "high", "middle", "low"])

    return summed(fit.select("x").mapInArrow(run, f"i int, {LIMBS}"), "i")


def sums_of(x: np.ndarray) -> np.ndarray:
    return x.sum(0) if len(x) * int(np.abs(x).max(initial=0)) < 1 << 62 else x.astype(object).sum(0)


class Whitening:
    """The whitening learned from the distinct grid vectors of a table.

    ``n`` distinct vectors of ``dims`` components whose grid values have the
    sums ``sums``; ``values`` and ``axes`` (dims x components) of the covariance,
    ``trace`` its trace.
    """

    def __init__(self, rows: DataFrame, components: int) -> None:
        self.fit = written(rows.select("dims", "x").distinct(), "whitening")
        low, high, self.n = self.fit.agg(F.min("dims"), F.max("dims"), F.count("*")).first()
        if low != high:
            raise ValueError(f"vectors of unequal length: {low} to {high} components")
        if not self.n:
            return
        self.dims = d = high
        n, found = self.n, totals(self.fit, sums_of, d)
        self.sums = [found[(i,)] for i in range(d)]
        # centred at the nearest whole number to each mean; the rest of the mean is taken off exactly
        self.middle = [(2 * s + n) // (2 * n) for s in self.sums]
        self.rest = [s - n * m for s, m in zip(self.sums, self.middle)]
        upper, middle = np.triu_indices(d), np.array(self.middle, np.int64)
        products = totals(self.fit, lambda x: gram(x - middle)[upper], len(upper[0]))
        v = np.zeros((d, d), np.longdouble)
        scale = np.longdouble(float(n)) ** 2
        for at, (i, j) in enumerate(zip(*(u.tolist() for u in upper))):
            whole = n * products[(at,)] - self.rest[i] * self.rest[j]
            first = float(whole)
            v[i, j] = v[j, i] = (np.longdouble(first) + np.longdouble(float(whole - int(first)))) / scale
        self.components = min(components, d)
        values, axes = eigen(v)
        self.trace = float(np.trace(v))
        self.values, self.axes = values[: self.components], axes[:, : self.components]
        #: Components along which the vectors vary at all.
        self.varies = self.values > max(values[0], 0) * d * 2.0**-50 if values[0] > 0 else np.zeros(self.components, bool)
        self.scaled = self.axes / np.sqrt(np.where(self.varies, self.values, 1))

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of grid vectors."""
        centred = (x - np.array(self.middle, np.int64)).astype(float) - np.array([r / self.n for r in self.rest])
        return centred @ self.scaled

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums over the components of ``(n * x - S)^2``."""
        y = x - np.array(self.middle, np.int64)
        top, rest = int(np.abs(y).max(initial=0)), max((abs(r) for r in self.rest), default=0)
        n, last = self.n, sum(r * r for r in self.rest)
        if self.dims * top * max(top, rest) < 1 << 62:
            a, b = (y * y).sum(1).tolist(), (y * np.array(self.rest, np.int64)).sum(1).tolist()
        else:
            big = y.astype(object)
            a, b = (big * big).sum(1).tolist(), (big * np.array(self.rest, object)).sum(1).tolist()
        return [n * n * p - 2 * n * q + last for p, q in zip(a, b)]

    def identity_error(self) -> float:
        """Largest absolute entry of the covariance of the whitened fit list less the identity, over the components that vary."""
        keep = np.flatnonzero(self.varies)
        if not len(keep):
            return 0.0
        project = self.project

        def run(batches):
            total = np.zeros((len(keep) + 1, len(keep)))
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    z = project(wide(batch.column(0).slice(at, BLOCK)))[:, keep]
                    total += np.vstack([z.T @ z, z.sum(0)])
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["i", "v"])

        found = {r["i"]: r["v"] for r in self.fit.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        total = np.array([found[i] for i in range(len(found))]).reshape(len(keep) + 1, len(keep)) / self.n
        mean = total[-1]
        return float(np.abs(total[:-1] - np.outer(mean, mean) - np.eye(len(keep))).max())

    def apply(self, rows: DataFrame) -> DataFrame:
        """``(vec_id, deviation, whitened)``: exact deviation as decimal digits, whitened coordinates (null along components without variance)."""
        varies, components = self.varies, self.components

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    piece = batch.slice(at, BLOCK)
                    x = wide(piece.column(1))
                    z = self.project(x)
                    mask = np.tile(~varies, len(z))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * components, pa.int32()), pa.array(z.ravel(), mask=mask))
                    yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([str(v) for v in self.deviations(x)]), lists], names=["vec_id", "deviation", "whitened"])

        return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation string, whitened array<double>")

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "fit"}


def whiten(vectors: DataFrame, components: int = 16, grid: int = GRID, shift: int = SHIFT) -> DataFrame:
    """Whitened coordinates of ``vectors(vec_id, embedding)``: a row for each vector and each of the first ``components``.

    ``vec_id, component`` (from 1, by falling variance), ``n`` (distinct grid
    vectors), ``deviation`` (decimal digits of the sum of ``(n * x - S)^2`` over
    the components), ``whitened``, ``explained`` (share of the variance) and
    ``identity_error``. ``x`` is ``floor(grid * c) + shift``; everything is
    learned from each distinct ``x`` once, covariances have the divisor n.

    Left out: vectors that are null, empty or hold null or non-finite
    components. Zero vectors take part. Every other row is returned, repeated
    rows and rows with a null vec_id too. Vectors of fewer components have that
    many rows. Along components without variance (fewer vectors than
    components, equal vectors) ``whitened`` is null and ``explained`` zero, and
    the identity is compared on the others. Grid values saturate at 2**61. The
    shift cancels in all results, so sums are kept without it. An empty table
    gives no rows; extra columns are ignored; vectors of unequal length raise
    ``ValueError``.
    """
    rows = on_grid(vectors, grid)
    model = Whitening(rows, components)
    if not model.n:
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation string, whitened double, explained double, identity_error double")
    explained = F.array(*[F.lit(float(v / model.trace) if ok else 0.0) for v, ok in zip(model.values, model.varies)])
    out = model.apply(rows).select("vec_id", "deviation", F.posexplode(F.arrays_zip("whitened", explained.alias("explained"))).alias("component", "of"))
    return out.select("vec_id", (F.col("component") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("of.whitened").alias("whitened"), F.col("of.explained").alias("explained"), F.lit(model.identity_error()).alias("identity_error"))
