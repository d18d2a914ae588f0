"""Embedding near-duplicates: an exact metric range join on cosine.

Unit vectors with cosine at least c lie within the Euclidean distance
e = sqrt(2 - 2c). Each vector lives in the cell of its nearest pivot and is
copied to every other cell whose boundary it may reach across: by the triangle
inequality only where the distance to the separating hyperplane is at most e.
Then the home cell of a vector holds all vectors within e of it, cells join
independently, and each home row counts its links there without any pair
being shuffled. A cell of many vectors is cut into rings by the distance to its
pivot, and by the same inequality a copy goes to the rings within e of its own
distance only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, cut, join_counted, partitions
from .vectors import matrix, same_length, unit, usable

#: Vectors the pivots are chosen from, at most, and rows of a cell or ring that share a task, about.
SAMPLE, HOMES = 8192, 16_384
#: Pivots at most: beyond, cells are cut into more rings, at most one for each of these quantiles of the distances.
PIVOTS, QUANTILES = 8192, 256


def choose_pivots(sample: np.ndarray, number: int) -> np.ndarray:
    """Farthest-first traversal of the sample."""
    u = unit(sample)
    chosen, far = [0], ((u - u[0]) ** 2).sum(1)
    while len(chosen) < min(number, len(u)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((u - u[chosen[-1]]) ** 2).sum(1))
    return u[chosen]


def reach(u: np.ndarray, pivots: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest pivot of each row, for each pivot whether the row may lie within eps of its cell, and the distances to the pivots."""
    d2 = np.maximum(2 - 2 * u @ pivots.T, 0)
    home = d2.argmin(1)
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
    gap = d2 - d2[np.arange(len(u)), home][:, None]
    near = gap <= 2 * eps * apart[home] + 1e-9
    near[np.arange(len(u)), home] = True
    return home, near, np.sqrt(d2)


def linked(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """Near-duplicate classes of ``vectors(vec_id, embedding)``: ``vec_id, n_links, component_id, kept``.

    ``n_links``: other vectors at cosine >= ``cosine`` (double precision);
    ``component_id``: smallest vec_id reachable by links; ``kept``: it is its
    own. Vectors that are null, zero or hold null or non-finite components
    link with nothing; magnitudes do not matter, up to the largest double.
    Equal vectors are joined once and count as many. Rows with a null vec_id
    are left out, repeated rows count once; an empty table gives no rows; extra
    columns are ignored. Usable vectors of unequal length raise ``ValueError``.
    """
    spark = vectors.sparkSession
    n_parts, eps = partitions(spark), math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-7
    rows = cut(usable(vectors).dropDuplicates(["vec_id", "vec"]))
    unique = cut(rows.groupBy("vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    same_length(unique)
    n = unique.count()
    sample = matrix(unique.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toArrow().column(0))
    everything = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id is not null").distinct()
    if not n:
        return everything.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    pivots = choose_pivots(sample, max(1, min(PIVOTS, -(-n // HOMES))))

    step = max(64, min(4096, 2_000_000 // len(pivots)))  # rows whose distances to all pivots are held at once

    def homes(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                home, _, far = reach(unit(matrix(batch.column(0).slice(at, step))), pivots, eps)
                yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), pa.array(far[np.arange(len(home)), home])], names=["cell", "far"])

    steps = F.array(*[F.lit((i + 1) / (QUANTILES + 1)) for i in range(QUANTILES)])
    placed = unique.select("vec").mapInArrow(homes, "cell int, far double")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("far", steps, 10_000).alias("q")).where(F.col("n") > HOMES).collect()
    # inner bounds of the rings of each crowded cell
    rings = {r["cell"]: np.array(r["q"])[np.linspace(0, QUANTILES - 1, min(QUANTILES, -(-r["n"] // HOMES) + 1)).round().astype(int)[1:-1]] for r in sizes}

    def deal(batches):
        """Home rows go to their ring of their cell; copies, and home rows as partners, to all rings within reach."""
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                home, near, far = reach(unit(matrix(piece.column(0))), pivots, eps)
                for c in np.flatnonzero(near.any(0)).tolist():
                    row = np.flatnonzero(near[:, c])
                    bounds, d = rings.get(c, np.empty(0)), far[row, c]
                    low, high = np.searchsorted(bounds, d - eps - 1e-9, "right"), np.searchsorted(bounds, d + eps + 1e-9, "right")
                    times = high - low + 1
                    ring = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - low, times)
                    own = np.repeat((home[row] == c), times) & (ring == np.repeat(np.searchsorted(bounds, d, "right"), times))
                    take = pa.array(np.repeat(row, times))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ring), c), pa.int32()), pa.array(ring, pa.int32()), pa.array(~own), piece.column(1).take(take), piece.column(2).take(take), piece.column(0).take(take)], names=["cell", "chunk", "guest", "id", "copies", "vec"])

    def join(batches):
        key, held = None, []

        def finish(forest, ids, links):
            stars = forest.stars()
            a = ids.tolist() + [x for x, _ in stars]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([None] * len(ids) + [y for _, y in stars], pa.int64()), pa.array(links.tolist() + [0] * len(stars), pa.int64())], names=["id", "root", "links"])

        own_ids = own = own32 = links = forest = None
        members: list[tuple] = []

        def meet(ids, copies, x):
            """Count the links of the home rows with these partners, in blocks."""
            nonlocal links
            for a in range(0, len(own), 1024):
                for b in range(0, len(x), 4096):
                    i, j = np.nonzero(own32[a : a + 1024] @ x[b : b + 4096].astype(np.float32).T >= cosine - 1e-5)
                    i, j = i + a, j + b
                    keep = own_ids[i] != ids[j]
                    i, j = i[keep], j[keep]
                    for s in range(0, len(i), 65536):
                        p, q = i[s : s + 65536], j[s : s + 65536]
                        ok = (own[p] * x[q]).sum(1) >= cosine
                        p, q = p[ok], q[ok]
                        np.add.at(links, p, copies[q])
                        for u, v in zip(own_ids[p].tolist(), ids[q].tolist()):
                            forest.union(u, v)

        def batch_parts(batch):
            k = np.stack([np.asarray(batch.column(j)).astype(np.int64) for j in (0, 1)], axis=1)
            edge = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
            for s, e in zip(edge, edge[1:]):
                if e > s:
                    yield tuple(k[s]), batch.slice(s, e - s)

        def columns(part):
            return np.asarray(part.column(3)), np.asarray(part.column(4)), unit(matrix(part.column(5)))

        def start():
            nonlocal own_ids, own, own32, links, forest
            own_ids, copies, own = (np.concatenate(c) for c in zip(*held)) if held else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, pivots.shape[1])))
            own32, links, forest = own.astype(np.float32), copies - 1, Forest()
            if len(own):
                meet(own_ids, copies, own)

        for batch in batches:
            for at, part in batch_parts(batch):
                if at != key:
                    if key is not None:
                        if forest is None:
                            start()
                        yield finish(forest, own_ids, links)
                    key, held, forest = at, [], None
                guest = np.asarray(part.column(2).to_numpy(zero_copy_only=False)).astype(bool)
                first = int(guest.argmax()) if guest.any() else len(guest)
                if first:
                    held.append(columns(part.slice(0, first)))
                if first < len(guest):
                    if forest is None:
                        start()
                    if len(own):
                        meet(*columns(part.slice(first)))
        if key is not None:
            if forest is None:
                start()
            yield finish(forest, own_ids, links)

    dealt = unique.select("vec", "id", "copies").mapInArrow(deal, "cell int, chunk int, guest boolean, id long, copies long, vec binary")
    ordered = dealt.repartition(n_parts, "cell", "chunk").sortWithinPartitions("cell", "chunk", "guest")
    found = cut(ordered.mapInArrow(join, "id long, root long, links long"))
    roots = components(found.where("root is not null").select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.where("root is null").groupBy("id").agg(F.sum("links").alias("n_links"))
    of_unique = unique.withColumnRenamed("copies", "rows_of_key").join(counts, "id").join(roots, "id", "left").select("vec", "rows_of_key", "n_links", F.coalesce("root", "id").alias("component_id"))
    of_rows = join_counted(rows, of_unique, "vec", rows.count()).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return everything.join(of_rows, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
