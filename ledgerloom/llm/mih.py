"""Approximate nearest neighbours by multi-index hashing.

Rows are parted by the size of their norms, a factor of two each, and within a
range one more component fills every vector up to the same norm, so that the
largest inner product is the smallest angle. Vectors get 256-bit codes: signs
after rotations learned on a bounded sample (iterative quantisation). Codes are
cut into sixteen substrings of 16 bits and every row stands in the index of each.

A query looks in each index up every substring value that differs from its own
in at most ``WITHIN_BITS`` bits. By the pigeonhole principle this retrieves each
code within a Hamming radius of ``COVERED``. Beyond that radius bits are weighed
by the margin of the query's own projection: all values within a ``reach`` are
looked up too, which retrieves each code whose weighted distance is below
sixteen times that reach, and of those farther away the ones with one near
substring. Retrieved rows within a Hamming radius of the whole code are reranked
on the original vectors. Reach and radius of every range are calibrated on the
sample; queries that found too few rows search again with both grown, at last
over all values. A range whose largest norm cannot lift a product over the k-th
best one that a query has with the rows of largest norm is not searched for it.

Index rows and probes meet by range, substring number and leading bits of the
value, so a query travels only to the parts of an index that its probes fall in.
A row that several substrings retrieve is passed on by the first of them alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions
from .vectors import exponents, matrix, same_length, shifted, usable

BITS, WORDS, PARTS = 256, 4, 16
#: Vectors the rotations and the radii are learned from, at most.
SAMPLE = 8192
#: Rows of an index cell and of a rerank shard, on average; larger cells are split.
SHARD = 16_384
#: Queries probed together in a cell.
BLOCK = 256
#: Share of true neighbours (of the sample) that some probe must meet, and that the Hamming radius must hold.
TARGET, WITHIN = 0.96, 0.99
#: Growth of the reach for queries that found too few rows.
GROWTH = 1.6
#: Bits of a substring that may always differ, and the Hamming radius which that covers.
WITHIN_BITS = 2
COVERED = PARTS * (WITHIN_BITS + 1) - 1
#: Margins are counted in whole steps of a unit vector's projection, up to the largest; the reach that takes in every value.
STEPS, LARGEST = 512, 255
FULL = 16.0 * LARGEST
#: Rows of largest norm whose products bound a query's k-th best from below.
PILOTS = 256
#: Neighbours of the sample in a range that are enough to calibrate it by itself.
ENOUGH = 64


def lift(x: np.ndarray, largest, query: bool) -> np.ndarray:
    """One more component turns the largest inner product into the smallest angle: stored vectors are filled up to one norm (of their range), queries have norm one."""
    if query:
        return np.column_stack([x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-300), np.zeros(len(x))])
    return np.column_stack([x, np.sqrt(np.maximum(largest**2 - (x**2).sum(1), 0))])


def learn_rotations(x: np.ndarray) -> np.ndarray:
    """Projection (dims x 256) of several rotations, each by alternating signs and an orthogonal fit."""
    rng, dims, out = np.random.default_rng(42), x.shape[1], []
    if dims > BITS:
        _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
        base = vt[:BITS].T
    else:
        base = np.eye(dims)
    z = x @ base
    while sum(r.shape[1] for r in out) < BITS:
        r = np.linalg.qr(rng.normal(size=(z.shape[1], z.shape[1])))[0]
        for _ in range(15 if len(z) else 0):
            u, _, vt = np.linalg.svd(z.T @ np.where(z @ r >= 0, 1.0, -1.0))
            r = u @ vt
        out.append(base @ r)
    return np.hstack(out)[:, :BITS]


def codes(projected: np.ndarray) -> np.ndarray:
    return np.packbits(projected >= 0, axis=1, bitorder="little").view("<u8").reshape(-1, WORDS)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)


def margins(projected: np.ndarray) -> np.ndarray:
    """Margins of the bits of unit queries, in steps."""
    return np.minimum(np.abs(projected) * STEPS, LARGEST).astype(np.uint8)


def graded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as ``2**exponent`` times vectors of norm 0.5 to 1: exponents, scaled vectors, their norms."""
    e = exponents(x)
    y = shifted(x, -e)
    m, more = np.frexp(np.sqrt((y**2).sum(1)))
    return e + more, shifted(y, -more.astype(np.int64)), m


def calibrate(x: np.ndarray, rotation: np.ndarray, ranges: dict[int, tuple[int, float]], k: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Reach of the probes and Hamming radius in each range, from the true neighbours within the sample that are as near as the k nearest of all rows."""
    reach, radius = np.full(len(ranges), FULL), np.full(len(ranges), BITS)
    if len(x) < 2:
        return reach, radius
    e, y, _ = graded(x)
    of, top_norm = np.array([ranges[i][0] for i in e.tolist()]), np.array([ranges[i][1] for i in e.tolist()])
    step = max(1, len(x) // 256)
    rank = max(1, min(-(-k * len(x) // max(rows, 1)), len(x) - 1))
    own, q = np.arange(0, len(x), step), y[::step]
    s = q @ shifted(y, np.maximum(e - e.max(), -1000)).T
    s[np.arange(len(q)), own] = -np.inf
    top = np.argpartition(-s, rank - 1, axis=1)[:, :rank]
    px, pq = lift(y, top_norm, False) @ rotation, lift(q, 1.0, True) @ rotation
    cx, cq, margin = codes(px), codes(pq), margins(pq).astype(float)
    nearest, apart = [], []
    for t, p, c, m in zip(top, pq, cq, margin):
        differ = (px[t] >= 0) != (p >= 0)
        nearest.append((differ * m).reshape(len(t), PARTS, -1).sum(2).min(1))
        apart.append(hamming(cx[t], c))
    nearest, apart, label = np.concatenate(nearest), np.concatenate(apart), of[np.concatenate(top)]
    for j in range(len(ranges)):
        mine = label == j if (label == j).sum() >= ENOUGH else np.ones(len(label), bool)
        reach[j] = np.quantile(nearest[mine], TARGET) + 1e-9
        radius[j] = max(COVERED, int(np.quantile(apart[mine], WITHIN)) + 1)
    return reach, radius


def probed(own: np.ndarray, margin: np.ndarray, prefix: int, bits: int, reach: float, within: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, value of the low ``bits`` bits) of the values that start with ``prefix`` and lie within ``reach`` of the queries' values, or differ from them in at most ``within`` bits."""
    differ = (own >> bits) ^ prefix
    cost, apart = np.zeros(len(own)), np.zeros(len(own), np.int64)
    for b in range(margin.shape[1] - bits):
        cost += np.where(differ >> b & 1, margin[:, bits + b], 0.0)
        apart += differ >> b & 1
    q = np.flatnonzero((cost <= reach) | (apart <= within))
    cost, apart, mask = cost[q], apart[q], np.zeros(len(q), np.int64)
    for b in range(bits):  # with and without this bit apart, as far as the reach or the number of bits goes
        more, count = cost + margin[q, b], apart + 1
        near = (more <= reach) | (count <= within)
        q, mask, cost, apart = np.r_[q, q[near]], np.r_[mask, mask[near] | 1 << b], np.r_[cost, more[near]], np.r_[apart, count[near]]
    by = np.argsort(q, kind="stable")
    return q[by], (own[q] ^ mask)[by] & ((1 << bits) - 1)


def first_met(code: np.ndarray, qcode: np.ndarray, margin: np.ndarray, part: int, reach: float) -> np.ndarray:
    """Whether no earlier substring than ``part`` has a probe for these codes."""
    if not part or not len(code):
        return np.ones(len(code), bool)
    differ = np.unpackbits((code ^ qcode).view(np.uint8).reshape(len(code), -1), axis=1, bitorder="little")[:, : 16 * part].reshape(len(code), part, 16)
    cost = (differ * margin[: 16 * part].reshape(part, 16).astype(np.int64)).sum(2)
    return ~((cost <= reach) | (differ.sum(2, dtype=np.int64) <= WITHIN_BITS)).any(1)


def search_cell(keys: np.ndarray, code: np.ndarray, part: int, prefix: int, bits: int, own: np.ndarray, margin: np.ndarray, qcode: np.ndarray, reach: float, radius: int):
    """Rows of one index cell (sorted by value) that the probes of each query meet within the radius, those that an earlier substring meets left out: yields (query, rows, rows met)."""
    start = np.searchsorted(keys, (prefix << bits) + np.arange((1 << bits) + 1))
    q, value = probed(own, margin[:, 16 * part : 16 * part + 16].astype(float), prefix, bits, reach, WITHIN_BITS)
    size = start[value + 1] - start[value]
    q, value, size = q[size > 0], value[size > 0], size[size > 0]
    edge = np.searchsorted(q, np.arange(len(own) + 1))
    for i in range(len(own)):
        s, n = start[value[edge[i] : edge[i + 1]]], size[edge[i] : edge[i + 1]]
        if not len(s):
            continue
        rows = np.repeat(s - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        met = len(rows)
        rows = rows[hamming(code[rows], qcode[i]) <= radius]
        rows = rows[first_met(code[rows], qcode[i], margin[i], part, reach)]
        if len(rows):
            yield i, rows, met


def streamed(batches, keys: int, stored: int):
    """Arrow batches of sorted rows as (key, kind, slice): rows of one key (first columns) and kind (the next) at a time."""
    for batch in batches:
        if batch.num_rows:
            k = np.stack([np.asarray(batch.column(j)).astype(np.int64) for j in range(keys + 1)], axis=1)
            edge = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
            for s, e in zip(edge, edge[1:]):
                yield tuple(k[s, :keys].tolist()), int(k[s, keys]), batch.slice(s, e - s)


def search(index: DataFrame, probes: DataFrame, bits: int, reach: np.ndarray, radius: np.ndarray, shards: int) -> DataFrame:
    """Candidates ``(shard, query_id, ids, met)`` of the probes in the index, one row per query, cell and rerank shard."""
    cells = index.groupBy("part", "prefix").agg(F.ceil(F.count("*") / (2 * SHARD)).cast("int").alias("chunks"))
    rows = index.join(cells, ["part", "prefix"]).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(7)), F.col("chunks")).cast("int"))
    asked = probes.join(cells, ["part", "prefix"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    columns = ["part", "prefix", "chunk", "kind", "value", "id", "code", "margin"]
    met = rows.withColumn("kind", F.lit(0)).withColumn("margin", F.lit(None).cast("binary")).select(columns).unionByName(asked.withColumn("kind", F.lit(1)).select(columns))

    def run(batches):
        key, held = None, []
        cell: tuple = ()
        for at, kind, part in streamed(batches, 3, 0):
            if at != key:
                key, held, cell = at, [], ()
            value, ids, code = np.asarray(part.column(4)).astype(np.int64), np.asarray(part.column(5)), np.frombuffer(b"".join(part.column(6).to_pylist()), "<u8").reshape(-1, WORDS)
            if kind == 0:
                held.append((value, ids, code))
                continue
            if not held:
                continue
            if not cell:
                v, i, c = (np.concatenate(x) for x in zip(*held))
                order = np.argsort(v, kind="stable")
                cell = v[order], i[order], c[order]
            keys, row_ids, row_codes = cell
            margin = np.frombuffer(b"".join(part.column(7).to_pylist()), np.uint8).reshape(len(ids), -1)
            span, index_part = divmod(key[0], PARTS)
            for b in range(0, len(ids), BLOCK):
                out: list[tuple] = []
                for i, rows, seen in search_cell(keys, row_codes, index_part, key[1], bits, value[b : b + BLOCK], margin[b : b + BLOCK], code[b : b + BLOCK], reach[span], radius[span]):
                    found = row_ids[rows]
                    of = found % shards
                    by = np.argsort(of, kind="stable")
                    found, of = found[by], of[by]
                    edge = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                    for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(found)]):
                        out.append((int(of[s]), int(ids[b + i]), found[s:e].tobytes(), seen if s == 0 else 0))
                cols = list(zip(*out)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.int64()))], names=["shard", "query_id", "ids", "met"])

    placed = met.repartition(partitions(index.sparkSession), "part", "prefix", "chunk").sortWithinPartitions("part", "prefix", "chunk", "kind")
    return placed.mapInArrow(run, "shard long, query_id long, ids binary, met long")


def rerank(found: DataFrame, rows: DataFrame, queries: DataFrame, shards: int, k: int) -> DataFrame:
    """``(query_id, vec_id, score)``: of each shard the k best candidates of each query, by inner product of the original vectors."""
    columns = ["shard", "kind", "query_id", "step", "id", "data"]
    null = F.lit(None).cast("long")
    vectors = rows.select(F.pmod("vec_id", F.lit(shards)).alias("shard"), F.lit(0).alias("kind"), null.alias("query_id"), F.lit(0).alias("step"), F.col("vec_id").alias("id"), F.col("vec").alias("data"))
    asked = found.select("shard", "query_id").distinct().join(queries.select(F.col("vec_id").alias("query_id"), "vec"), "query_id")
    asked = asked.select("shard", F.lit(1).alias("kind"), "query_id", F.lit(0).alias("step"), null.alias("id"), F.col("vec").alias("data"))
    lists = found.select("shard", F.lit(1).alias("kind"), "query_id", F.lit(1).alias("step"), null.alias("id"), F.col("ids").alias("data"))
    together = vectors.unionByName(asked).unionByName(lists).select(columns)

    def run(batches):
        key, held, cell = None, [], ()
        query, lists = None, []

        def settle() -> pa.RecordBatch:
            ids = np.unique(np.concatenate([np.frombuffer(x, "<i8") for x in lists])) if lists else np.empty(0, np.int64)
            ids = ids[ids != query[0]]
            row_ids, vectors = cell
            at = np.searchsorted(row_ids, ids)
            q = np.frombuffer(query[1], "<f8")[None]
            eq, x = exponents(q), vectors[at]
            ex = exponents(x)
            score = np.ldexp((shifted(x, -ex) * shifted(q, -eq)).sum(1), np.clip(ex + eq, -4000, 4000).astype(np.int32))
            best = np.lexsort((ids, -score))[:k]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(best), query[0])), pa.array(ids[best]), pa.array(score[best])], names=["query_id", "vec_id", "score"])

        for at, kind, part in streamed(batches, 1, 0):
            if at != key:
                if query is not None:
                    yield settle()
                key, held, cell, query, lists = at, [], (), None, []
            if kind == 0:
                held.append((np.asarray(part.column(4)), matrix(part.column(5))))
                continue
            if not cell:
                ids, x = (np.concatenate(c) for c in zip(*held))
                order = np.argsort(ids, kind="stable")
                cell = ids[order], x[order]
            for q, step, data in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(5).to_pylist()):
                if step == 0:
                    if query is not None:
                        yield settle()
                    query, lists = (q, data), []
                else:
                    lists.append(data)
        if query is not None:
            yield settle()

    placed = together.repartition(partitions(rows.sparkSession), "shard").sortWithinPartitions("shard", "kind", "query_id", "step")
    return placed.mapInArrow(run, "query_id long, vec_id long, score double")


class Search:
    """The index of usable vectors, learned and dealt; :meth:`nearest` answers queries, :meth:`candidates` tells what the probes met."""

    def __init__(self, vectors: DataFrame, k: int) -> None:
        self.k = k
        self.rows = cut(usable(vectors).groupBy("vec_id").agg(F.min("vec").alias("vec")))
        self.dims = same_length(self.rows)
        self.n = self.rows.count()
        if not self.n:
            return

        def grade(batches):
            for batch in batches:
                e, _, m = graded(matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(e, pa.int64()), pa.array(m)], names=["vec_id", "vec", "e", "m"])

        norms = self.rows.select("vec_id", "vec").mapInArrow(grade, "vec_id long, vec binary, e long, m double")
        # one row for each power of two: few, whatever the number of vectors
        tops = norms.groupBy("e").agg(F.max("m").alias("m")).orderBy(F.desc("e")).collect()
        self.ranges = {r["e"]: (j, r["m"]) for j, r in enumerate(tops)}
        self.highest = tops[0]["e"]
        pilots = norms.orderBy(F.desc("e"), F.desc("m"), "vec_id").limit(PILOTS).select("vec").toArrow().column(0)
        self.pilots = shifted(matrix(pilots), -self.highest)
        sample = self.rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").toArrow().column(0)
        x = matrix(sample)
        e, y, _ = graded(x)
        self.rotation = learn_rotations(lift(y, np.array([self.ranges[i][1] for i in e.tolist()]), False))
        self.reach, self.radius = calibrate(x, self.rotation, self.ranges, k, self.n)
        self.shards = max(1, -(-self.n // SHARD))
        self.bits = max(0, 16 - max(0, (self.shards - 1).bit_length()))  # of a value within its cell
        one_each = Window.partitionBy("vec").orderBy("vec_id")
        self.indexed = cut(self.rows.withColumn("copy", F.row_number().over(one_each)).where(F.col("copy") <= k + 1).drop("copy"))
        self.index = self._entries(self.indexed)

    def _entries(self, rows: DataFrame, reach: np.ndarray | None = None) -> DataFrame:
        """Index rows, or with a reach the probes of each cell that some value within it falls in: ``part, prefix, value, id, code`` (, ``margin``); ``part`` counts ranges and substrings."""
        rotation, ranges, bits, pilots, k, highest = self.rotation, self.ranges, self.bits, self.pilots, self.k, self.highest
        spans = sorted(ranges.items(), reverse=True)
        # largest norms of the ranges as seen from the pilots' scale
        norm = np.array([m * 2.0 ** max(e - highest, -1000) for e, (_, m) in spans])

        def entries(part, row, prefix, value, ids, raw):
            take = pa.array(row)
            return [pa.array(np.full(len(row), part), pa.int32()), pa.array(prefix, pa.int32()), pa.array(value, pa.int32()), ids.take(take), raw.take(take)]

        def stored(batches):
            for batch in batches:
                for s in range(0, batch.num_rows, 2048):
                    piece = batch.slice(s, 2048)
                    e, y, _ = graded(matrix(piece.column(1)))
                    of = np.array([ranges[i][0] for i in e.tolist()], np.int64)
                    code = codes(lift(y, np.array([ranges[i][1] for i in e.tolist()]), False) @ rotation)
                    value, raw = code.view("<u2").astype(np.int64), pa.array([c.tobytes() for c in code], pa.binary())
                    everyone = np.arange(len(y))
                    for t in range(PARTS):
                        cols = entries(t, everyone, value[:, t] >> bits, value[:, t], piece.column(0), raw)
                        cols[0] = pa.array(of * PARTS + t, pa.int32())
                        yield pa.RecordBatch.from_arrays(cols, names=["part", "prefix", "value", "id", "code"])

        def asked(batches):
            for batch in batches:
                for s in range(0, batch.num_rows, 2048):
                    piece = batch.slice(s, 2048)
                    _, y, _ = graded(matrix(piece.column(1)))
                    unit = lift(y, 1.0, True)
                    p = unit @ rotation
                    code, margin = codes(p), margins(p)
                    value, raw = code.view("<u2").astype(np.int64), pa.array([c.tobytes() for c in code], pa.binary())
                    weights = pa.array([m.tobytes() for m in margin], pa.binary())
                    bound = np.full(len(y), -np.inf)
                    if len(pilots) > k:  # one more than k, as a query may be a pilot itself
                        s_pilot = unit[:, :-1] @ pilots.T
                        bound = -np.partition(-s_pilot, k, axis=1)[:, k]
                    for j in range(len(spans)):
                        able = np.flatnonzero(norm[j] >= bound - 1e-9 * np.abs(bound))
                        for t in range(PARTS if len(able) else 0):
                            row, prefix = probed(value[able, t] >> bits, margin[able, 16 * t + bits : 16 * t + 16].astype(float), 0, 16 - bits, reach[j], WITHIN_BITS)
                            row = able[row]
                            cols = entries(j * PARTS + t, row, prefix, value[row, t], piece.column(0), raw)
                            yield pa.RecordBatch.from_arrays([*cols, weights.take(pa.array(row))], names=["part", "prefix", "value", "id", "code", "margin"])

        return rows.select("vec_id", "vec").mapInArrow(stored if reach is None else asked, "part int, prefix int, value int, id long, code binary" + ("" if reach is None else ", margin binary"))

    def candidates(self, queries: DataFrame, reach: np.ndarray, radius: np.ndarray) -> DataFrame:
        return search(self.index, self._entries(queries, reach), self.bits, reach, radius, self.shards)

    def nearest(self, queries: DataFrame) -> DataFrame:
        """The k nearest found of each query row ``(vec_id, vec)``: ``query_id, rank, vec_id, score``."""
        k, reach, radius = self.k, self.reach, self.radius
        copies = self.indexed.count()
        wanted = min(k, self.n - 1)
        top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        done, left = None, queries
        while True:
            found = cut(self.candidates(left, reach, radius))
            best = rerank(found, self.indexed, left, self.shards, k).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
            best = cut(best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
            whole = best.groupBy("query_id").count().where(F.col("count") >= wanted).select("query_id")
            last = bool((reach >= FULL).all())
            settled = best if last else best.join(whole, "query_id", "left_semi")
            done = settled if done is None else done.unionByName(settled)
            if last:
                return done
            left = cut(left.join(whole, F.col("vec_id") == F.col("query_id"), "left_anti"))
            if not left.head(1):
                return done
            # at the end every value is probed and every code lies within the radius
            if reach.max() < FULL / 4 and copies > 4 * k:
                reach, radius = reach * GROWTH + 1, np.minimum(BITS, radius + 24)
            else:
                reach, radius = np.full(len(reach), FULL), np.full(len(radius), BITS)


def nearest(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """The ``k`` rows of largest inner product of each query row: ``query_id, rank, vec_id, score``.

    ``vectors(vec_id, embedding)``; ``is_query``: condition on vec_id. A row is
    no neighbour of itself, its copies are. Ties go to the smaller vec_id; with
    fewer than k other rows all are returned. Vectors that are null, zero or
    hold null or non-finite components take no part; an empty table gives no
    rows; extra columns are ignored; a repeated id counts once, with the least
    of its vectors by bytes. Products beyond the range of doubles are infinite
    or zero. Usable vectors of unequal length raise ``ValueError``. Of equal
    vectors only the k + 1 smallest ids can be returned, so only those are
    indexed.
    """
    found = Search(vectors, k)
    if not found.n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return found.nearest(found.rows.where(is_query))
