"""Centroid clustering with bounds loosened by the norm of total displacement.

Every vector keeps the distance to its centroid and, for each group of
centroids, a lower bound on the distance to the others, both with the round in
which they were evaluated. The centroids of all rounds are retained. In a later
round a bound is loosened by how far a centroid lies from where it was in that
round: the norm of the sum of its moves, which the sum of the norms never
undercuts. Where the loosened bounds leave no doubt, a vector stays without any
distance being computed; the groups that fail are scanned again exactly, in
whole numbers, so that ties are decided exactly too.

A round is one pass over the partitions, which writes the state of the vectors
and, in rows of its own, the sums of those that moved; nothing is shuffled but
these sums.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import LIMBS, finite_rows, limbs, narrow, summed, wide

#: Groups of centroids that share a bound, at most; up to this many clusters each centroid has its own.
GROUPS = 64
#: Rows evaluated at once.
BLOCK = 4096
#: Rounding of distances and bounds is far below this share.
SLACK = 1e-9

STATE = "vec_id long, x binary, cluster int, distance long, at short, bound binary, bound_at binary, moved int, scanned long, " + LIMBS
COLUMNS = [c.split()[0] for c in STATE.split(", ")]
TYPES = {"long": pa.int64(), "int": pa.int32(), "short": pa.int16(), "binary": pa.binary()}


def largest(dims: int) -> int:
    """Magnitude at which grid values saturate, so that squared distances fit 64 bits: 2**26 at 64 dimensions."""
    return 1 << (54 - (dims - 1).bit_length()) // 2 + 2


def on_grid(vectors: DataFrame, grid: int, dims: int) -> DataFrame:
    """``(vec_id, x)`` of the vectors of ``dims`` finite components, ``x`` the packed ``floor(grid * c)``."""

    def run(batches):
        for batch in batches:
            ok, lengths, flat = finite_rows(batch.column(1))
            edge = np.r_[0, np.cumsum(lengths)]
            rows = np.flatnonzero(ok & (lengths == dims))
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(flat[edge[rows][:, None] + np.arange(dims)] * grid), -largest(dims), largest(dims)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(narrow(x), pa.binary())], names=["vec_id", "x"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, x binary")


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of smallest sha256 of ``<seed>:<vec_id>``; of a repeated id the vector of smaller components first."""

    def run(batches):
        for batch in batches:
            ordered = (wide(batch.column(1)).astype(np.uint64) ^ np.uint64(1 << 63)).astype(">u8")  # bytes sort like the numbers
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([v.tobytes() for v in ordered], pa.binary())], names=["vec_id", "x", "ordered"])

    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    keyed = rows.where("vec_id is not null").mapInArrow(run, "vec_id long, x binary, ordered binary")
    return wide(keyed.orderBy(hashed, "ordered").limit(k).select("x").toArrow().column(0))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number rows to whole-number centroids."""
    top, far = int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0))
    if x.shape[1] * (top + far) ** 2 < 1 << 52:
        product = (x.astype(float) @ c.astype(float).T).astype(np.int64)
    else:
        product = x @ c.T
    return (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * product


class Bounds:
    """Assignment of blocks of vectors in one round; ``history`` holds the centroids of all rounds up to it."""

    def __init__(self, history: list[np.ndarray]) -> None:
        self.round, self.centroids = len(history) - 1, history[-1]
        self.k = len(self.centroids)
        self.groups = min(GROUPS, self.k)
        self.group = np.arange(self.k) % self.groups
        #: moved[T, j]: distance of centroid j from its place in round T; group_moved[T, g]: the largest of a group.
        self.moved = np.stack([np.sqrt(((self.centroids - old).astype(float) ** 2).sum(1)) for old in history])
        self.group_moved = np.stack([self.moved[:, self.group == g].max(1) for g in range(self.groups)], axis=1)

    def _lowest(self, d: np.ndarray, group: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Smallest distance within a group, own centroids left out, rounded down."""
        d = np.where(group[None, :] == own[:, None], np.inf, d)
        return (d.min(1, initial=np.inf) * (1 - 2e-7)).astype("<f4")

    def first(self, x: np.ndarray):
        d2 = squares(x, self.centroids)
        own = d2.argmin(1)
        d = np.sqrt(d2.astype(float))
        low = np.stack([self._lowest(d[:, self.group == g], np.flatnonzero(self.group == g), own) for g in range(self.groups)], axis=1)
        return own, d2[np.arange(len(x)), own], np.zeros(len(x), np.int64), low, np.zeros(low.shape, np.int64), d2.size

    def again(self, x: np.ndarray, own: np.ndarray, d2: np.ndarray, at: np.ndarray, low: np.ndarray, low_at: np.ndarray, exact: bool):
        """Same, from the stored state; ``exact``: every distance to the own centroid is evaluated."""
        now, scanned, old = self.round, 0, own
        own, d2, at, low, low_at = own.copy(), d2.copy(), at.copy(), low.copy(), low_at.copy()
        bound = low.astype(float) - self.group_moved[low_at, np.arange(self.groups)[None, :]]
        upper = np.sqrt(d2.astype(float)) + self.moved[at, own]
        doubt = (bound <= upper[:, None] * (1 + SLACK)).any(1)
        rows = np.arange(len(x)) if exact else np.flatnonzero(doubt)
        for j in np.unique(own[rows]).tolist():  # the own distance first: it is often enough
            r = rows[own[rows] == j]
            d2[r], at[r] = squares(x[r], self.centroids[j : j + 1])[:, 0], now
        scanned += len(rows)
        upper[rows] = np.sqrt(d2[rows].astype(float))
        fails = bound <= upper[:, None] * (1 + SLACK)
        best, nearest = d2.copy(), own.copy()
        held = []
        for g in range(self.groups):
            r = np.flatnonzero(fails[:, g])
            if len(r):
                members = np.flatnonzero(self.group == g)
                s = squares(x[r], self.centroids[members])
                scanned += s.size
                held.append((g, r, members, s))
                i = s.argmin(1)
                value = s[np.arange(len(r)), i]
                better = (value < best[r]) | ((value == best[r]) & (members[i] < nearest[r]))
                best[r[better]], nearest[r[better]] = value[better], members[i[better]]
        for g, r, members, s in held:
            low[r, g], low_at[r, g] = self._lowest(np.sqrt(s.astype(float)), members, nearest[r]), now
        # a centroid that was left counts among the others of its group from now on
        left = np.flatnonzero(nearest != old)
        g = self.group[old[left]]
        again = ~fails[left, g]
        r, g = left[again], g[again]
        known = np.minimum(low[r, g].astype(float) - self.group_moved[low_at[r, g], g], np.sqrt(d2[r].astype(float)))
        low[r, g], low_at[r, g] = (np.maximum(known, 0) * (1 - 2e-7)).astype("<f4"), now
        at[left] = now
        return nearest, best, at, low, low_at, scanned


@dataclass
class Clusters:
    """``rows(vec_id, cluster, distance)``, the centroids at last, and how many distances were evaluated in each round."""

    rows: DataFrame
    centroids: list[list[int]]
    scanned: list[int]


def _pass(state: DataFrame, history: list[np.ndarray], last: bool) -> DataFrame:
    """One round over the vectors; the first one starts from ``(vec_id, x)``."""
    fresh = len(history) == 1

    def record(**columns):
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c] if c in columns else [None] * n, TYPES[t]) for c, t in (x.split() for x in STATE.split(", "))], names=COLUMNS)

    def run(batches):
        bounds = Bounds(history)
        change, count, scanned = np.zeros(bounds.centroids.shape, object), np.zeros(bounds.k, np.int64), 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(start, BLOCK)
                x = wide(piece.column(1))
                if fresh:
                    old = np.full(len(x), -1)
                    own, d2, at, low, low_at, n = bounds.first(x)
                else:
                    old = np.asarray(piece.column(2)).astype(np.int64)
                    bytes_of = lambda j, t: np.frombuffer(b"".join(piece.column(j).to_pylist()), t).reshape(len(x), -1)
                    own, d2, at, low, low_at, n = bounds.again(x, old, np.asarray(piece.column(3)), np.asarray(piece.column(4)).astype(np.int64), bytes_of(5, "<f4"), bytes_of(6, "<u2").astype(np.int64), last)
                scanned += n
                moved = np.flatnonzero(own != old)
                for j in np.unique(own[moved]).tolist():
                    r = moved[own[moved] == j]
                    change[j] = change[j] + x[r].sum(0)
                    count[j] += len(r)
                for j in np.unique(old[moved]).tolist():
                    if j >= 0:
                        r = moved[old[moved] == j]
                        change[j] = change[j] - x[r].sum(0)
                        count[j] -= len(r)
                held = {} if last else {"x": piece.column(1), "at": at, "bound": [v.tobytes() for v in low.astype("<f4")], "bound_at": [v.tobytes() for v in low_at.astype("<u2")]}
                yield record(vec_id=piece.column(0), cluster=own, distance=d2, **held)
        if scanned:
            total = np.column_stack([count.astype(object), change]).ravel().tolist()
            keep = [i for i, v in enumerate(total) if v]
            yield record(moved=[-1, *keep], scanned=[scanned] + [None] * len(keep), **_limb_columns([0, *[total[i] for i in keep]]))

    return state.mapInArrow(run, STATE)


def _limb_columns(values: list[int]) -> dict[str, list[int]]:
    return dict(zip((c.split()[0] for c in LIMBS.split(", ")), limbs(values)))


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, grid: int = 64, dims: int = 64) -> Clusters:
    """Clusters of ``vectors(vec_id, embedding)`` around ``k`` whole-number centroids after ``rounds`` rounds.

    Components become ``floor(grid * c)``. The first centroids are the vectors
    of smallest sha256 of ``<seed>:<vec_id>``. A round assigns every vector to
    the nearest centroid (ties: the smaller number) and moves each centroid that
    has vectors to the floor of their mean; at last all are assigned once more.

    Left out: vectors that are null, hold null or non-finite components or have
    another number of components than ``dims``. Zero vectors take part; every
    other row is returned, repeated rows too; rows with a null vec_id are
    clustered but never a first centroid. Repeated ids are ordered by their
    components there. With fewer than k vectors there are as many centroids;
    an empty table gives no rows; extra columns are ignored. Grid values
    saturate at :func:`largest`. The driver holds centroids and their sums only.
    """
    start = on_grid(vectors, grid, dims)
    spark = vectors.sparkSession
    history = [first_centroids(start, k, seed)]
    if not len(history[0]):
        return Clusters(spark.createDataFrame([], "vec_id long, cluster int, distance long"), [], [])
    state, scanned, width = start, [], dims + 1
    total = [0] * (len(history[0]) * width)
    for _ in range(rounds):
        table = written(_pass(state, history, False), "clusters")
        for (i,), v in summed(table.where("moved >= 0"), "moved").items():
            total[i] += v
        scanned.append(int(table.agg(F.sum("scanned")).first()[0] or 0))
        moved = history[-1].copy()
        for j in range(len(moved)):
            n, sums = total[j * width], total[j * width + 1 : (j + 1) * width]
            if n:
                moved[j] = [s // n for s in sums]
        history.append(moved)
        state = table.where("moved is null").select(*COLUMNS[:7])
    table = written(_pass(state, history, True), "clusters")
    scanned.append(int(table.agg(F.sum("scanned")).first()[0] or 0))
    return Clusters(table.where("moved is null").select("vec_id", "cluster", "distance"), history[-1].tolist(), scanned)


def clusters_with_inertia(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, grid: int = 64, dims: int = 64) -> DataFrame:
    """Result of :func:`cluster` with the inertia of each cluster and of all, and the digest of each centroid.

    Inertia beyond 64 bits is null.
    """
    found = cluster(vectors, k, rounds, seed, grid, dims)
    spark = vectors.sparkSession
    schema = "cluster int, centroid_sha256 string"
    digests = spark.createDataFrame([(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(found.centroids)], schema)
    sums = {r["cluster"]: r["s"] for r in found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    of_cluster = spark.createDataFrame([(j, str(s)) for j, s in sums.items()], "cluster int, s string").select("cluster", F.col("s").try_cast("long").alias("cluster_inertia"), F.lit(str(sum(sums.values()))).try_cast("long").alias("inertia"))
    # one row per centroid
    return found.rows.join(F.broadcast(of_cluster.join(digests, "cluster")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
