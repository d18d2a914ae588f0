"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are cut into partitions of correlated bits. Each partition gets
its own threshold t_i >= -1 (-1: not probed), and two fingerprints become
candidates when they agree within t_i on some partition i. If the sum of
(t_i + 1) exceeds a radius, no pair within the radius is missed. Where documents
must be found by similarity, the fingerprints of similar ones differ in too many
bits for that; then the thresholds must make the expected share of missed pairs
at that similarity small enough. In both cases a dynamic programme picks the
thresholds of least cost, by candidate counts estimated on a bounded sample of
fingerprints; the sample steers cost only. Every candidate is verified: on the
whole fingerprint, and for similarities on the shingle sets themselves.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, byte_values, components, cut, fresh, join_counted, mix64, partitions

#: Rows of a probing cell on average, and at most; larger cells are dealt as pairs of chunks.
CELL, CHUNK = 131_072, 524_288
#: Fingerprints looked at on the driver to group bits, and of these to estimate candidates.
SAMPLE, ESTIMATE = 20_000, 1024
#: Bytes of text, and documents, in one chunk of a verification cell, about.
CELL_BYTES, CELL_DOCS = 16 << 20, 8192
#: Expected share of pairs at the wanted similarity that the probes may miss.
MISS = 1e-3
#: What looking one probe up, and shuffling one row, costs, in candidate verifications.
LOOKUP_COST, ROW_COST = 4.0, 200.0
#: Steps that gains are counted in when thresholds are allocated.
STEP = 1 / 64
#: Contents (bit counts) of each byte value, least significant bit first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, ngram: int) -> np.ndarray:
    """XXH64 (seed 42) of each word n-gram of the lower-cased text, in order, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    if n <= ngram:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip((ends - sizes)[: n - ngram + 1].tolist(), ends[ngram - 1 :].tolist())), np.uint64, n - ngram + 1)


class WordHashes(dict):
    """Hashes of words; remembers a bounded number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word, 42)
        return out


def shingle_set(text: bytes, ngram: int, memo: WordHashes) -> np.ndarray:
    """The distinct word n-grams of the lower-cased text as sorted 64-bit hashes, made from the hashes of their words."""
    words = text.lower().split()
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    size = min(ngram, len(h))
    if not size:
        return h
    out = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        out = (out ^ h[j : len(h) - size + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(mix64(out))


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """Majority bits of 64-bit hashes; further words take hashes remixed with the word's number."""
    n = len(hashes)
    if not n:
        return np.zeros(words, np.uint64)
    counts = np.zeros((words * 8, 256), np.int64)
    offsets = np.arange(words * 8, dtype=np.int32) * 256
    for at in range(0, n, 8192):
        part = hashes[at : at + 8192]
        full = np.empty((len(part), words), "<u8")
        full[:, 0] = part
        for k in range(1, words):
            full[:, k] = mix64(part + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))
        cells = full.view(np.uint8).reshape(-1, words * 8) + offsets
        counts += np.bincount(cells.ravel(), minlength=words * 8 * 256).reshape(words * 8, 256)
    return np.packbits(((counts @ BITS) * 2 > n).ravel(), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, ngram: int = 4, words: int = 1, distinct: bool = False) -> DataFrame:
    """``(doc_id, fp array<long>)`` of each document; ``distinct``: shingles count once."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece, out = batch.slice(at, 1000), []
                for text in byte_values(piece.column(1)):
                    h = shingle_hashes(text, ngram)
                    out.append(fingerprint(np.unique(h) if distinct else h, words).view(np.int64).tolist())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp array<long>")


def unpack(column: pa.Array, words: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64, copy=False).view(np.uint64).reshape(-1, words)


def bit(fps: np.ndarray, b: int) -> np.ndarray:
    return (fps[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)


def part_values(fps: np.ndarray, part: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for i, b in enumerate(part):
        out |= bit(fps, b) << np.uint64(i)
    return out


def group_bits(sample: np.ndarray, bits: int, m: int) -> list[list[int]]:
    """Put correlated bits into the same partition, widths as equal as possible."""
    x = np.stack([bit(sample, b) for b in range(bits)], axis=1).astype(float) if len(sample) else np.zeros((0, bits))
    if len(x) > 1:
        x = x - x.mean(0)
        norm = np.sqrt((x**2).sum(0))
        corr = np.abs(x.T @ x) / np.maximum(np.outer(norm, norm), 1e-9)
    else:
        corr = np.zeros((bits, bits))
    np.fill_diagonal(corr, 0)
    free, parts = np.ones(bits, bool), []
    for k in range(m):
        width = int(free.sum()) // (m - k)
        part = [int(np.where(free, corr[:, free].sum(1), -1).argmax())]
        free[part[0]] = False
        to_part = corr[:, part[0]].copy()
        while len(part) < width:
            best = int(np.where(free, to_part, -1).argmax())
            part.append(best)
            free[best] = False
            to_part += corr[:, best]
        parts.append(sorted(part))
    return parts


def flips(width: int, t: int) -> list[int]:
    """Masks of at most t bits, the empty one first."""
    return [sum(1 << b for b in c) for k in range(t + 1) for c in combinations(range(width), k)]


def estimate(values: np.ndarray, width: int, top: int, scale: float, rows: int) -> list[float]:
    """Cost of a partition at each threshold -1 to ``top``: candidates of the sample carried to all rows, probes looked up, rows shuffled."""
    u, c = np.unique(values, return_counts=True)
    prefix = prefix_bits(rows, width)
    out, found = [0.0], -float(len(values))
    for t in range(top + 1):
        masks = flips(width, t)
        for mask in masks if t == 0 else masks[sum(math.comb(width, k) for k in range(t)) :]:
            at = np.searchsorted(u, u ^ np.uint64(mask))
            hit = (at < len(u)) & (u[np.minimum(at, len(u) - 1)] == (u ^ np.uint64(mask)))
            found += float((c[hit] * c[at[hit]]).sum())
        shuffled = sum(math.comb(prefix, k) for k in range(t + 1))
        out.append(found * scale**2 / 2 + (LOOKUP_COST * len(masks) + ROW_COST * shuffled) * rows)
    return out


def prefix_bits(rows: int, width: int) -> int:
    """Leading bits of a partition's value that name its cell."""
    return min(width, max(0, math.ceil(math.log2(max(1, rows) / CELL))))


def cheapest(parts: list[list[int]], sample: np.ndarray, rows: int, top: int, gain, target: float) -> tuple[float, list[int]] | None:
    """Thresholds of least cost whose gains reach the target, by dynamic programming over the partitions."""
    goal, scale = math.ceil(target / STEP - 1e-9), max(1.0, rows / max(1, len(sample)))
    table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in parts:
        cost = estimate(part_values(sample, part), len(part), top, scale, rows) if len(sample) else [float(t + 1) for t in range(-1, top + 1)]
        gains = [0] + [int(gain(len(part), t) / STEP + 1e-9) for t in range(top + 1)]
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in table.items():
            for t in range(-1, top + 1):
                k = min(goal, used + gains[t + 1])
                if k not in after or c + cost[t + 1] < after[k][0]:
                    after[k] = (c + cost[t + 1], [*ts, t])
        table = after
    return table.get(goal)


def chosen(sample: np.ndarray, bits: int, rows: int, numbers, top: int, gain, target: float) -> list[tuple[list[int], int]] | None:
    """Partitions and thresholds: of each number of partitions the cheapest thresholds, of these the cheapest."""
    best = None
    for m in numbers:
        parts = group_bits(sample, bits, m)
        found = cheapest(parts, sample[:ESTIMATE], rows, top, gain, target)
        if found and (best is None or found[0] < best[0]):
            best = (found[0], [(p, t) for p, t in zip(parts, found[1]) if t >= 0])
    return best and best[1]


def allocate(sample: np.ndarray, bits: int, radius: int, rows: int) -> list[tuple[list[int], int]]:
    """Partitions with thresholds that bring every pair within the radius together."""
    found = chosen(sample, bits, rows, range(1, min(bits // 8, radius + 2) + 1), 2, lambda width, t: t + 1.0, radius + 1.0)
    if not found:
        raise ValueError(f"no thresholds up to 2 cover a radius of {radius} of {bits} bits")
    return found


def bit_error(similarity: float) -> float:
    """Probability that a bit differs between fingerprints of sets of this Jaccard similarity."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def agreement(width: int, t: int, p: float) -> float:
    """Probability that at most t of ``width`` bits differ."""
    return sum(math.comb(width, k) * p**k * (1 - p) ** (width - k) for k in range(t + 1))


def words_for(rows: int, similarity: float, miss: float = MISS) -> int:
    """64-bit words of a fingerprint that leave enough partitions, whose width grows with the logarithm of the rows."""
    width, p = least_width(rows), bit_error(similarity)
    number = math.log(miss) / math.log(1 - agreement(width + 1, 2, p)) if p else 1
    return max(4, math.ceil((math.ceil(number) + 2) * width / 64))


def least_width(rows: int) -> int:
    return max(10, math.ceil(math.log2(max(2, rows))) - 2)


def allocate_similar(sample: np.ndarray, bits: int, rows: int, similarity: float, miss: float = MISS) -> list[tuple[list[int], int]]:
    """Partitions with thresholds that are expected to miss at most ``miss`` of the pairs at this similarity."""
    p = bit_error(similarity)
    widths = range(least_width(rows), least_width(rows) + 3)
    return chosen(sample, bits, rows, sorted({bits // w for w in widths}), 2, lambda width, t: -math.log(max(1e-12, 1 - agreement(width, t, p))), -math.log(miss))


def near_in_group(fps: np.ndarray, ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest (id, root) of the links within one bucket, by breadth-first search over the rows not reached yet."""
    left, a, b = np.arange(len(fps)), [], []
    while len(left) > 1:
        root, frontier, left = left[0], [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]).sum(1) <= radius
            if near.any():
                hit = left[near]
                frontier.extend(hit.tolist())
                a.append(ids[hit])
                b.append(np.full(len(hit), ids[root]))
                left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def cell_links(values: np.ndarray, fps: np.ndarray, ids: np.ndarray, width: int, t: int, radius: int, first: int, small: int = 4096, block: int = 1 << 19):
    """Links (a, b) among rows whose values differ in at most t bits: pairs of small buckets, forests of large ones.

    Pairs whose first words differ in more than ``first`` bits are not looked at further.
    """
    order = np.argsort(values, kind="stable")
    values, fps, ids = values[order], fps[order], ids[order]
    head = np.ascontiguousarray(fps[:, 0])
    start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    u, n = values[start], np.diff(np.r_[start, len(values)])
    for mask in flips(width, t):
        if mask:  # each pair of buckets from its lower value
            a = np.flatnonzero((u >> np.uint64(mask.bit_length() - 1)) & np.uint64(1) == 0)
            at = np.minimum(np.searchsorted(u, u[a] ^ np.uint64(mask)), len(u) - 1)
            hit = u[at] == u[a] ^ np.uint64(mask)
            a, b = a[hit], at[hit]
        else:
            a = b = np.flatnonzero(n > 1)
        pairs = n[a] * n[b]
        for x, y in zip(a[pairs > small].tolist(), b[pairs > small].tolist()):
            rows = np.arange(start[x], start[x] + n[x])
            if y != x:
                rows = np.r_[rows, np.arange(start[y], start[y] + n[y])]
            yield near_in_group(fps[rows], ids[rows], radius)
        a, b, pairs = a[pairs <= small], b[pairs <= small], pairs[pairs <= small]
        ends = np.cumsum(pairs)
        cuts = np.searchsorted(ends, np.arange(block, (ends[-1] if len(ends) else 0) + block, block))
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pairs)]):
            if e > s:
                q = np.repeat(np.arange(s, e), pairs[s:e])
                k = np.arange(len(q)) - np.repeat(ends[s:e] - pairs[s:e] - (ends[s - 1] if s else 0), pairs[s:e])
                of = n[b[q]]
                x = k // of
                x, y = start[a[q]] + x, start[b[q]] + (k - x * of)
                near = np.flatnonzero(np.bitwise_count(head[x] ^ head[y]) <= first)
                x, y = x[near], y[near]
                near = np.bitwise_count(fps[x] ^ fps[y]).sum(1) <= radius
                if not mask:
                    near &= x < y
                yield ids[x[near]], ids[y[near]]


def links(distinct: DataFrame, words: int, radius: int, parts: list[tuple[list[int], int]], rows: int, first: int | None = None) -> DataFrame:
    """Edges ``(a, b)`` that connect all ``(id, fp)`` within the radius that some partition brings together.

    ``first``: bits in which the first words may differ (by default those of
    the radius). A row goes to the cell of the leading bits of each partition's value, and
    as a guest to the lower cells that its threshold reaches; all probing of
    the other bits is done within the cell, which gives a spanning forest of its
    links: no more edges than rows.
    """
    spark = distinct.sparkSession
    prefix = [prefix_bits(rows, len(p)) for p, _ in parts]
    masks = [flips(c, t) for c, (_, t) in zip(prefix, parts)]

    def deal(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                piece = batch.slice(at, 2000)
                fps = unpack(piece.column(1), words)
                raw = pa.array([x.tobytes() for x in fps], pa.binary())
                for i, (p, _) in enumerate(parts):
                    home = (part_values(fps, p) >> np.uint64(len(p) - prefix[i])).astype(np.int64)
                    for mask in masks[i]:
                        row = np.flatnonzero(home ^ mask < home) if mask else np.arange(len(home))
                        take = pa.array(row)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), i), pa.int32()), pa.array((home ^ mask)[row]), piece.column(0).take(take), raw.take(take)], names=["part", "cell", "id", "fp"])

    def verify(batches):
        held: list[tuple] = []
        last = None

        def settle():
            fps, ids = np.concatenate([f for f, _ in held]), np.concatenate([i for _, i in held])
            (p, t), forest = parts[last[0]], Forest()
            for a, b in cell_links(part_values(fps, p), fps, ids, len(p), t, radius, radius if first is None else first):
                for x, y in zip(a.tolist(), b.tolist()):
                    forest.union(x, y)
            stars = forest.stars()
            if stars:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*stars)], names=["a", "b"])

        for batch in batches:
            k = np.stack([np.asarray(batch.column(j)).astype(np.int64) for j in range(4)], axis=1)
            edge = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
            for s, e in zip(edge, edge[1:]):
                if e == s:
                    continue
                if held and tuple(k[s]) != last:
                    yield from settle()
                    held = []
                last = tuple(k[s].tolist())
                part = batch.slice(s, e - s)
                held.append((np.frombuffer(b"".join(part.column(5).to_pylist()), np.uint64).reshape(-1, words), np.asarray(part.column(4))))
        if held:
            yield from settle()

    dealt = distinct.mapInArrow(deal, "part int, cell long, id long, fp binary")
    crowds = cut(dealt.groupBy("part", "cell").agg(F.count("*").alias("rows_of_key")))
    total, most = crowds.agg(F.sum("rows_of_key"), F.max("rows_of_key")).first()
    if (most or 0) <= CHUNK:
        cells = dealt.select("part", "cell", F.lit(0).alias("ci"), F.lit(0).alias("cj"), "id", "fp")
    else:
        both = join_counted(dealt, crowds.withColumn("c", F.ceil(F.col("rows_of_key") / CHUNK).cast("int")), ["part", "cell"], total)
        cells = chunk_pairs(both, "part", "cell").select("part", "cell", "ci", "cj", "id", "fp")
    return cells.repartition(partitions(spark), "part", "cell", "ci", "cj").sortWithinPartitions("part", "cell", "ci", "cj").mapInArrow(verify, "a long, b long")


def chunk_pairs(rows: DataFrame, *key: str) -> DataFrame:
    """Deal rows ``(key, id, c)`` of groups of ``c`` chunks to all pairs of their chunk with others: ``ci, cj``."""
    both = rows.withColumn("x", F.pmod(F.xxhash64("id"), F.col("c")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    return both.withColumn("ci", F.least("x", "y")).withColumn("cj", F.greatest("x", "y"))


def sampled(unique: DataFrame, words: int) -> np.ndarray:
    """Fingerprints of a bounded sample of ``unique(id, fp)``, by a hash of the id."""
    return unpack(unique.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("fp").toArrow().column(0).combine_chunks(), words)


def near_duplicates(docs: DataFrame, ngram: int = 4, words: int = 1, radius: int = 4, distinct: bool = False, parts: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """Near-duplicate components of ``docs(doc_id, text)``: ``(doc_id, fp, component_id)``.

    ``ngram``: words in a shingle; ``words``: 64-bit words in a fingerprint;
    ``radius``: differing bits at which two documents still link, small enough
    for thresholds up to 2 to cover it (others raise ``ValueError``). No link is
    missed; ``parts`` given are probed as they are. Null texts count as empty;
    documents with fewer words than a shingle hash their whole word sequence;
    those without words have fingerprint zero and link like any other. Equal
    fingerprints are collapsed before probing, so any number of copies costs
    one row. Repeated rows and ids are kept, each row under its id's text; rows
    with a null id are left out; an empty table gives no rows; extra columns
    are ignored.
    """
    fps = cut(fingerprints(docs.where("doc_id is not null").select("doc_id", "text"), ngram, words, distinct))
    unique = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")))
    rows = unique.count()
    if parts is None:
        parts = allocate(sampled(unique, words), 64 * words, radius, rows)
    # fingerprints are nodes by themselves, since one id may have several texts
    named = cut(unique.withColumn("node", F.col("fp")[0] if words == 1 else F.xxhash64("fp")))
    roots = components(links(named.select(F.col("node").alias("id"), "fp"), words, radius, parts, rows))
    classed = named.withColumnRenamed("id", "doc").join(roots, F.col("node") == F.col("id"), "left").select("fp", "doc", "copies", F.coalesce("root", "node").alias("class"))
    least = classed.groupBy("class").agg(F.min("doc").alias("component_id"), F.count("*").alias("rows_of_key"))
    classed = join_counted(classed, least, "class", rows).select("fp", "component_id", F.col("copies").alias("rows_of_key"))
    return join_counted(fps, classed, "fp", fps.count()).select("doc_id", "fp", "component_id")


def signatures(docs: DataFrame, ngram: int, words: int) -> DataFrame:
    """``(doc_id, k1, k2, fp, sig, n)`` of each row of ``docs(doc_id, text)``: hashes of the text, fingerprint and 128-bit digest of the shingle set, bytes of the text."""
    schema = "doc_id long, k1 long, k2 long, fp array<long>, sig binary, n long"

    def run(batches):
        memo = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece, fps, sigs, sizes = batch.slice(at, 500), [], [], []
                for text in byte_values(piece.column(3)):
                    h = shingle_set(text, ngram, memo)
                    fps.append(fingerprint(h, words).view(np.int64).tolist())
                    sigs.append(xxhash.xxh3_128_digest(h.tobytes()))
                    sizes.append(len(text))
                yield pa.RecordBatch.from_arrays([*(piece.column(j) for j in range(3)), pa.array(fps, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())], names=["doc_id", "k1", "k2", "fp", "sig", "n"])

    return keyed(docs).mapInArrow(run, schema)


def keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, k1, k2, text)``, the text named by two hashes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text")


def similar_in_group(sets: list[np.ndarray], fps: np.ndarray, ids: np.ndarray, radius: int, similarity: float) -> list[tuple[int, int]]:
    """A forest (id, root) of the pairs within the radius whose shingle sets have at least the Jaccard similarity."""
    size = np.array([len(s) for s in sets])
    left, out = np.arange(len(ids)), []
    while len(left) > 1:
        root, frontier, left = left[0], [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]).sum(1) <= radius
            near &= np.minimum(size[left], size[x]) >= similarity * np.maximum(size[left], size[x]) - 1e-9
            at = np.flatnonzero(near & (size[left] > 0))
            reached = []
            for s in range(0, len(at) if size[x] else 0, 512):
                some = at[s : s + 512]
                flat = np.concatenate([sets[y] for y in left[some]])
                place = np.minimum(np.searchsorted(sets[x], flat), size[x] - 1)
                both = np.add.reduceat((sets[x][place] == flat).astype(np.int64), np.r_[0, np.cumsum(size[left[some]])[:-1]])
                reached.append(some[both >= similarity * (size[left[some]] + size[x] - both) - 1e-9])
            if reached:
                at = np.concatenate(reached)
                frontier.extend(left[at].tolist())
                out.extend((int(ids[y]), int(ids[root])) for y in left[at])
                left = np.delete(left, at)
    return out


def groups(docs: DataFrame, similarity: float = 0.8, ngram: int = 5, miss: float = MISS) -> DataFrame:
    """Groups of near copies among ``docs(doc_id, text)``: ``(doc_id, k1, k2, root)``, one row per document.

    Documents whose sets of word shingles have at least the Jaccard
    ``similarity`` are in one group, numbered ``root``; k1 and k2 name the text.
    Fingerprints find candidates only: those that share a probed partition
    within its threshold, and differ in no more bits than the mean at that
    similarity and three standard deviations, form crowds; within a crowd a link
    is kept if the shingle sets themselves are similar enough. ``miss``: expected
    share of pairs at just this similarity that no probe brings together (nearer
    ones are missed less). Rows of equal shingle sets, without words too, link
    and cost one row; null texts count as empty; null ids and repeated rows are
    rows like others; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    total = docs.count()
    words, p = words_for(total, similarity, miss), bit_error(similarity)

    def most(bits: int, deviations: float) -> int:
        return math.ceil(bits * p + deviations * math.sqrt(bits * p * (1 - p)))

    radius = most(64 * words, 3.3)
    sets = cut(signatures(docs, ngram, words))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k1", "k2")
    unique = sets.groupBy("sig").agg(F.min(place).alias("rep"), F.min("fp").alias("fp"), F.max("n").alias("n"), F.count("*").alias("rows_of_key"))
    unique = cut(unique.withColumn("id", F.monotonically_increasing_id()))  # numbered once, as checkpointed
    number = unique.count()
    parts = allocate_similar(sampled(unique, words), 64 * words, number, similarity, miss)
    near = components(links(unique.select("id", "fp"), words, radius, parts, number, most(64, 4.0)))
    members = cut(near.unionByName(near.select(F.col("root").alias("id"), "root").distinct()).join(unique.select("id", "fp", "n", "rep"), "id"))
    # crowds too large for a task are dealt as pairs of chunks
    chunks = F.greatest(F.ceil(F.count("*") / CELL_DOCS), F.ceil(F.sum("n") / CELL_BYTES)).cast("int")
    crowds = members.groupBy("root").agg(chunks.alias("c"), F.count("*").alias("rows_of_key"))
    dealt = chunk_pairs(join_counted(members, crowds, "root", members.count()), "root").select("root", "ci", "cj", "id", "fp", *[F.col(f"rep.{c}").alias(f"{c}_") for c in ("doc_id", "k1", "k2")])
    texts = keyed(docs)
    cells = texts.join(dealt, (F.col("k1") == F.col("k1_")) & (F.col("k2") == F.col("k2_")) & F.col("doc_id").eqNullSafe(F.col("doc_id_"))).select("root", "ci", "cj", "id", "fp", "text")

    def verify(batches):
        held: list[tuple] = []
        last, memo = None, WordHashes()

        def settle():
            edges = similar_in_group([s for _, _, s in held], np.array([f for _, f, _ in held], np.int64).view(np.uint64), np.array([i for i, _, _ in held], np.int64), radius, similarity) if len(held) > 1 else []
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], names=["a", "b"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                keys = zip(*(piece.column(j).to_pylist() for j in (0, 1, 2)))
                for key, i, f, text in zip(keys, piece.column(3).to_pylist(), piece.column(4).to_pylist(), byte_values(piece.column(5))):
                    if key != last and held:
                        yield from settle()
                        held = []
                    if key == last and held and held[-1][0] == i:
                        continue  # a repeated row
                    last = key
                    held.append((i, f, shingle_set(text, ngram, memo)))
        if held:
            yield from settle()

    placed = cells.repartition(partitions(spark), "root", "ci", "cj").sortWithinPartitions("root", "ci", "cj", "id")
    roots = components(placed.mapInArrow(verify, "a long, b long"))
    named = unique.join(roots, "id", "left").select("sig", "rows_of_key", F.coalesce("root", "id").alias("root"))
    return join_counted(sets.select("sig", "doc_id", "k1", "k2"), named, "sig", total).select("doc_id", "k1", "k2", "root")


def one_of_each(docs: DataFrame, similarity: float = 0.8, ngram: int = 5) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id, rows without an id last.

    Groups as in :func:`groups`. Of repeated rows one stays; all columns are
    kept as they are.
    """
    found = cut(groups(docs, similarity, ngram))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k1", "k2")
    kept = found.groupBy("root").agg(F.min(order).alias("x")).select("root", "x.doc_id", "x.k1", "x.k2")
    rows = found.groupBy("root", "doc_id", "k1", "k2").count().withColumnsRenamed({c: f"{c}_" for c in ("root", "doc_id", "k1", "k2")})
    same = (F.col("root") == F.col("root_")) & (F.col("k1") == F.col("k1_")) & (F.col("k2") == F.col("k2_")) & F.col("doc_id").eqNullSafe(F.col("doc_id_"))
    kept = cut(kept.join(rows, same).select("doc_id", "k1", "k2", "count"))
    doc, k1, k2 = fresh(docs, "doc", "k1", "k2")
    texts = docs.withColumns({k1: F.xxhash64("text"), k2: F.xxhash64(F.lit(1), "text")})

    def these(some: DataFrame) -> DataFrame:
        some = some.select(F.col("doc_id").alias(doc), F.col("k1").alias(f"{k1}_"), F.col("k2").alias(f"{k2}_"))
        return texts.join(some, (texts[k1] == F.col(f"{k1}_")) & (texts[k2] == F.col(f"{k2}_")) & texts["doc_id"].eqNullSafe(F.col(doc)), "left_semi")

    single, repeated = kept.where(F.col("count") == 1), kept.where(F.col("count") > 1)
    if not repeated.head(1):
        return these(single).select(*docs.columns)
    return these(single).unionByName(these(repeated).dropDuplicates(["doc_id", k1, k2])).select(*docs.columns)


def similar(docs: DataFrame, similarity: float = 0.8, ngram: int = 5) -> DataFrame:
    """Components ``(doc_id, root)`` of near copies, ``root`` the smallest doc_id of the group; groups as in :func:`groups`."""
    found = cut(groups(docs, similarity, ngram))
    least = found.groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows_of_key"))
    return join_counted(found, least, "root", found.count()).select("doc_id", F.col("least").alias("root"))
