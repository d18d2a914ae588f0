"""Removal of repeated byte strings with suffix arrays.

Every window of ``length`` bytes is assigned to its minimiser, the gram with
the least hash in it; equal windows share the minimiser's content, wherever
they stand. Runs of adjacent windows with one minimiser make a segment. Only
segments whose minimiser occurs elsewhere can hold repeats. Equal segments are
pre-aggregated and repeat as a whole; the distinct segments of a minimiser
meet in one task, where a suffix array decides window by window: suffixes
smaller than their successors are sorted directly, the others are induced by
scanning the buckets, and common prefixes of neighbours mark what repeats. A
minimiser with too many distinct segments for one task, as of a common passage
in ever new surroundings, is dealt as pairs of a few chunks; beyond a dozen
chunks its windows are compared one by one instead: they are counted by 128 bits
of hash, which is linear in the segments.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_values, fresh, join_counted, mix64, partitions, written

#: Bytes of a minimiser gram.
GRAM = 64
#: Window starts looked at together, and bytes of a suffix array.
PIECE, ARRAY = 1 << 21, 1 << 20
#: Distinct segments of one minimiser that meet in a suffix array; more are dealt as pairs of chunks.
CHUNK = 4096
#: Chunks up to which that moves fewer bytes than the windows of the segments would; those of more are counted by their hashes.
PAIRED = 12
#: Salts that the rows of a hot segment are dealt by.
SALTS = 256
#: Segments that hot minimisers are found on, about.
SAMPLE = 500_000


def words_at(buffer: np.ndarray, order: str) -> np.ndarray:
    """The 8 bytes from each position on as a number."""
    return np.ndarray((max(0, len(buffer) - 7),), order + "u8", buffer.tobytes(), 0, (1,)).astype(np.uint64)


def gram_hashes(buffer: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each position on, by doubling."""
    h, size = words_at(buffer, "<") * np.uint64(0x9E3779B97F4A7C15), 8
    h ^= h >> np.uint64(29)
    while size < GRAM:
        h = h[: len(h) - size] * np.uint64(0xD6E8FEB86659FD93) + h[size:]
        h ^= h >> np.uint64(32)
        size *= 2
    return mix64(h)


#: Odd numbers whose powers weigh the bytes of a segment in its two hashes.
BASES = (0x5851F42D4C957F2D, 0xC2B2AE3D27D4EB4F)


@functools.lru_cache(maxsize=4)
def _powers(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumprod(np.full(size, base, np.uint64)), np.cumprod(np.full(size, pow(base, -1, 1 << 64), np.uint64))


def powers(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and their inverses, at least ``size`` of them."""
    return _powers(1 << 18 if size <= 1 << 18 else PIECE + (1 << 16), base)


def segments(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a text: minimiser hash, 128 bits of hash of the segment in two halves, first window, windows."""
    n = len(text) - length + 1
    if n < 1:
        return (np.empty(0, np.uint64),) * 3 + (np.empty(0, np.int64),) * 2
    h = gram_hashes(text)
    # high bits decide, then the leftmost position: both depend on the window's content alone
    key = (h & ~np.uint64((1 << 23) - 1)) | np.arange(len(h), dtype=np.uint64)
    grams, low, size = length - GRAM + 1, key, 1
    while size * 2 <= grams:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    low = np.minimum(low[:n], low[grams - size : grams - size + n])
    at = (low & np.uint64((1 << 23) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    count = np.diff(np.r_[first, n])
    # of the segment: its grams at both ends and in steps cover it; polynomial sums over all its bytes tell the rest
    ends = h[first] + h[first + count - 1 + length - GRAM] * np.uint64(3) + h[first + length - GRAM] * np.uint64(7) + count.astype(np.uint64)
    bytes_, whole = text.astype(np.uint64) + np.uint64(1), []
    for base in BASES:
        power, inverse = powers(len(text), base)
        total = np.r_[np.uint64(0), np.cumsum(bytes_ * power[: len(text)], dtype=np.uint64)]
        body = (total[first + count - 1 + length] - total[first]) * inverse[first]
        whole.append(mix64(body ^ mix64(ends ^ np.uint64(base))))
    return h[at[first]], whole[0], whole[1], first, count


def window_hashes(text: np.ndarray, count: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash of each of the first ``count`` windows of a segment, in two halves: its grams in steps and at its end, and polynomial sums over all its bytes."""
    h, at = gram_hashes(text), np.arange(count)
    grams = np.zeros(count, np.uint64)
    for k, d in enumerate([*range(0, length - GRAM, GRAM), length - GRAM]):
        grams += h[at + d] * np.uint64(2 * k + 1)
    bytes_, out = text.astype(np.uint64) + np.uint64(1), []
    for base in BASES:
        power, inverse = powers(len(text), base)
        total = np.r_[np.uint64(0), np.cumsum(bytes_ * power[: len(text)], dtype=np.uint64)]
        out.append(mix64(((total[at + length] - total[at]) * inverse[at]) ^ mix64(grams ^ np.uint64(base))))
    return out[0], out[1]


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """Segments of all texts ``(rid, text)``: ``h, g, g2, rid, first, n``."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                piece, out = batch.slice(start, 1000), [[] for _ in types]
                for rid, text in zip(piece.column(0).to_pylist(), byte_values(piece.column(1))):
                    raw = np.frombuffer(text, np.uint8)
                    for s in range(0, max(1, len(raw) - length + 1), PIECE):
                        h, g, g2, first, n = segments(raw[s : s + PIECE + length - 1], length)
                        for c, x in zip(out, (h.view(np.int64), g.view(np.int64), g2.view(np.int64), np.full(len(h), rid), first + s, n)):
                            c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, types)], names=["h", "g", "g2", "rid", "first", "n"])

    return docs.mapInArrow(run, "h long, g long, g2 long, rid long, first int, n int")


def smaller_than_successor(t: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than the next one; the last is not."""
    step = np.sign(np.diff(t.astype(np.int16), append=-1)).astype(np.int8)
    known = np.where(step != 0, np.arange(len(t)), len(t))
    return step[np.minimum.accumulate(known[::-1])[::-1]] > 0


def sort_direct(rows: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
    """Sort suffixes by their first ``depth`` bytes, eight at a time; only groups that still differ are sorted on."""
    order = rows[np.argsort(word[rows], kind="stable")]
    k = word[order]
    start = np.r_[True, k[1:] != k[:-1]] if len(k) else np.empty(0, bool)
    for at in range(8, depth, 8):
        alone = start & np.r_[start[1:], True]
        idx = np.flatnonzero(~alone)
        if not len(idx):
            break
        k, head = word[order[idx] + at], start[idx]
        group = np.cumsum(head)
        differs = np.r_[False, (k[1:] != k[:-1]) & ~head[1:]]
        if not differs.any():
            continue
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[differs]] = True
        sub = np.flatnonzero(mixed[group])
        by = sub[np.lexsort((k[sub], group[sub]))]
        order[idx[sub]] = order[idx[by]]
        ks, gs = k[by], group[by]
        start[idx[sub[1:]]] |= (ks[1:] != ks[:-1]) | (gs[1:] != gs[:-1])
    return order


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``t`` in order of their first ``depth`` bytes at least, by two-stage sorting."""
    n = len(t)
    if not n:
        return np.empty(0, np.int64)
    word = words_at(np.r_[t, np.zeros(depth + 16, np.uint8)], ">")
    small = smaller_than_successor(t)
    direct = sort_direct(np.flatnonzero(small), word, depth)
    edge = np.searchsorted(t[direct], np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    pending[t[n - 1]].append(np.array([n - 1]))  # induced by the empty suffix
    out: list[np.ndarray] = []

    def induce(scanned: np.ndarray) -> np.ndarray:
        """Predecessors that are larger than what was scanned, in order of the scan."""
        before = scanned[scanned > 0] - 1
        return before[~small[before]]

    def put(rows: np.ndarray) -> None:
        c = t[rows]
        by = np.argsort(c, kind="stable")
        rows, c = rows[by], c[by]
        cut = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(rows)]):
            pending[c[a]].append(rows[a:b])

    for c in range(256):
        scan = np.concatenate(pending[c]) if pending[c] else np.empty(0, np.int64)
        pending[c] = []
        while len(scan):
            out.append(scan)
            found = induce(scan)
            same = t[found] == c
            if not same.all():
                put(found[~same])
            scan = found[same]
        bucket = direct[edge[c] : edge[c + 1]]
        if len(bucket):
            out.append(bucket)
            found = induce(bucket)
            if len(found):
                put(found)
    return np.concatenate(out)


def repeated_windows(parts: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For each segment, which of its first ``counts`` windows occur at another place in the segments."""
    t = np.frombuffer(b"".join(parts), np.uint8)
    base = np.cumsum([0, *map(len, parts)])
    valid = np.zeros(len(t), bool)
    for b, n in zip(base, counts):
        valid[b : b + n] = True
    order = suffix_array(t, length)
    order = order[valid[order]]
    word = words_at(np.r_[t, np.zeros(length + 16, np.uint8)], "<")
    # neighbours with a common prefix of at least the length
    left, right = order[:-1], order[1:]
    at = np.arange(len(left))
    for d in [*range(0, length - 7, 8), length - 8]:
        at = at[word[left[at] + d] == word[right[at] + d]]
    hit = np.zeros(len(t), bool)
    hit[left[at]] = True
    hit[right[at]] = True
    return [hit[b : b + n] for b, n in zip(base, counts)]


def spans_of(first: int, hit: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges that the hit windows cover, windows being numbered from ``first``."""
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return [(first + int(a), first + int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2])]


def hot_minimisers(every: DataFrame, total: int) -> list[int]:
    """Minimisers of more than about a thousandth of the segments, of which there are fewer than a thousand: counted on a bounded sample, which steers cost only."""
    share = min(1.0, SAMPLE / max(1, total))
    counts = every.sample(share, seed=42).groupBy("h").count()
    return [r.h for r in counts.where(F.col("count") > max(100, share * total / 1000)).orderBy(F.desc("count"), "h").limit(1000).collect()]


def candidates(every: DataFrame) -> DataFrame:
    """Segments whose minimiser occurs elsewhere, with ``same``: 1 where no other segment is equal, else more.

    Segments meet by minimiser in one shuffle and are counted there. Rows of the
    few hot minimisers are dealt by segment and salt; those alone in their salt
    look up whether an equal one lies in another.
    """
    total = every.count()
    hot, segment = F.col("h").isin(hot_minimisers(every, total)), ["h", "g", "g2"]
    usual = every.where(~hot).repartition(partitions(every.sparkSession), "h")
    usual = usual.withColumn("same", F.count("*").over(Window.partitionBy(*segment))).withColumn("c", F.count("*").over(Window.partitionBy("h"))).where("c > 1").drop("c")
    often = every.where(hot)
    salted = often.withColumn("same", F.count("*").over(Window.partitionBy(*segment, F.pmod(F.xxhash64("rid", "first"), F.lit(SALTS)))))
    several = often.groupBy(*segment).agg(F.count("*").alias("all")).where(F.col("all") > 1)
    alone = salted.where("same = 1").join(several, segment, "left").withColumn("same", F.coalesce("all", "same")).drop("all")
    return usual.unionByName(salted.where("same > 1")).unionByName(alone)


def repeated_spans(placed: DataFrame, text: str = "text", rid: str = "rid", length: int = 200) -> DataFrame:
    """Ranges of the texts covered by strings of ``length`` bytes that occur again: ``rid, spans``.

    ``placed``: rows dealt by ``rid`` (the shuffle serves the caller as well,
    so all columns stay). Segments count as equal where minimiser and 128 bits
    of hash agree. Lists are of one document each, and no longer than its text.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    spark = placed.sparkSession
    n_parts = partitions(spark)
    every = written(anchors(placed.select(F.col(rid).alias("rid"), F.col(text).alias("text")), length), "anchors")
    found = written(candidates(every), "candidates")
    segment = ["h", "g", "g2"]
    whole = F.struct(F.col("first").alias("s"), (F.col("first") + F.col("n") - 1 + length).alias("e"))
    copied = found.where("same > 1").select("rid", F.array(whole).alias("spans"))
    distinct = written(found.groupBy(*segment).agg(F.max("same").alias("c"), F.min(F.struct("rid", "first", "n")).alias("x")).select(*segment, "c", "x.*"), "segments")

    # distinct segments of one minimiser are compared; one that is alone in it was settled by its count
    total = distinct.count()
    crowd = distinct.groupBy("h").agg(F.count("*").alias("rows_of_key")).where("rows_of_key > 1").withColumn("k", F.ceil(F.col("rows_of_key") / CHUNK).cast("int"))
    dealt = join_counted(distinct, crowd.where(F.col("k") <= PAIRED), "h", total).withColumn("a", F.pmod("g", F.col("k")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("rid", F.struct("h", F.least("a", "b").alias("ci"), F.greatest("a", "b").alias("cj"), (F.col("c") > 1).alias("known"), "first", "n").alias("x"))
    wanted = dealt.groupBy("rid").agg(F.collect_list("x").alias("wanted"))
    crowded = crowd.where(F.col("k") > PAIRED).drop("k")

    (rid_, wanted_), at = fresh(placed, "wanted_by", "wanted"), {c: i for i, c in enumerate(placed.columns)}

    def extract(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                piece = batch.slice(start, 500)
                for number, raw, rows in zip(piece.column(at[rid]).to_pylist(), byte_values(piece.column(at[text])), piece.column(len(at) + 1).to_pylist()):
                    for a in range(0, len(rows), 5000):
                        part = rows[a : a + 5000]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([x[c] for x in part], t) for c, t in (("h", pa.int64()), ("ci", pa.int32()), ("cj", pa.int32()), ("known", pa.bool_()), ("first", pa.int32()), ("n", pa.int32()))]
                            + [pa.array([number] * len(part), pa.int64()), pa.array([raw[x["first"] : x["first"] + x["n"] - 1 + length] for x in part], pa.binary())],
                            names=["h", "ci", "cj", "known", "first", "n", "rid", "bytes"],
                        )

    def decide(batches):
        held: list[dict] = []
        size, last = 0, None

        def settle(rows: list[dict]):
            out: dict[int, list] = {}
            for x, hit in zip(rows, repeated_windows([x["bytes"] for x in rows], [x["n"] for x in rows], length)):
                if not x["known"] and hit.any():
                    out.setdefault(x["rid"], []).extend(spans_of(x["first"], hit, length))
            return pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([[{"s": s, "e": e} for s, e in v] for v in out.values()], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))], names=["rid", "spans"])

        for batch in batches:
            for x in batch.to_pylist():
                key = (x["h"], x["ci"], x["cj"])
                # chunk pairs of one minimiser share segments and must not meet in one array
                if held and key != last and (size >= ARRAY or key[0] == last[0]):
                    yield settle(held)
                    held, size = [], 0
                last = key
                held.append(x)
                size += len(x["bytes"])
        if held:
            yield settle(held)

    def windows(batches):
        """Hashes of all windows of the segments of crowded minimisers."""
        types = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64())
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                piece, out = batch.slice(start, 100), [[] for _ in types]
                for number, raw, rows in zip(piece.column(at[rid]).to_pylist(), byte_values(piece.column(at[text])), piece.column(len(at) + 1).to_pylist()):
                    for x in rows:
                        n = x["n"]
                        w1, w2 = window_hashes(np.frombuffer(raw[x["first"] : x["first"] + n - 1 + length], np.uint8), n, length)
                        for c, v in zip(out, (np.full(n, number), np.full(n, x["first"]), np.arange(n), np.full(n, x["known"]), w1.view(np.int64), w2.view(np.int64))):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, types)], names=["rid", "first", "k", "known", "w1", "w2"])

    def texts_with(lists: DataFrame) -> DataFrame:
        return placed.join(lists.withColumnsRenamed({"rid": rid_, "wanted": wanted_}), F.col(rid) == F.col(rid_))

    met = texts_with(wanted).mapInArrow(extract, "h long, ci int, cj int, known boolean, first int, n int, rid long, bytes binary")
    decided = met.repartition(n_parts, "h", "ci", "cj").sortWithinPartitions("h", "ci", "cj").mapInArrow(decide, "rid long, spans array<struct<s:int,e:int>>")
    all_spans = copied.unionByName(decided)
    if crowded.head(1):
        of_crowd = join_counted(distinct, crowded, "h", total).select("rid", F.struct((F.col("c") > 1).alias("known"), "first", "n").alias("x")).groupBy("rid").agg(F.collect_list("x").alias("wanted"))
        each = written(texts_with(of_crowd).mapInArrow(windows, "rid long, first int, k int, known boolean, w1 long, w2 long"), "windows")
        again = each.groupBy("w1", "w2").agg(F.count("*").alias("rows_of_key")).where("rows_of_key > 1")
        # windows of a segment that repeats as a whole are covered already
        hits = join_counted(each.where("not known"), again, ["w1", "w2"], each.count())
        window = F.struct((F.col("first") + F.col("k")).alias("s"), (F.col("first") + F.col("k") + length).alias("e"))
        all_spans = all_spans.unionByName(hits.groupBy("rid", "first").agg(F.collect_list(window).alias("spans")).select("rid", "spans"))
    return all_spans.groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(spans: list | None) -> list[tuple[int, int]]:
    """Maximal runs of a list of ranges."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans if x is not None) if spans is not None else ():
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def keep_rest(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for s, e in runs:
        parts.append(text[at:s])
        at = e
    return b"".join([*parts, text[at:]]) if runs else text


def with_row_ids(docs: DataFrame, name: str) -> DataFrame:
    """A 64-bit number of each row by its id and text: equal rows share it, which is right for them; should others, a second hash tells them apart."""
    second = F.xxhash64(F.lit(1), "text", "doc_id")
    rows = docs.withColumn(name, F.xxhash64("doc_id", "text"))
    low, high = fresh(rows, "low", "high")
    clash = rows.groupBy(name).agg(F.min(second).alias(low), F.max(second).alias(high)).where(F.col(low) != F.col(high)).select(name, low)
    if clash.head(1):
        rows = rows.join(clash, name, "left").withColumn(name, F.when(F.col(low).isNull(), F.col(name)).otherwise(second)).drop(low)
    return rows


def digests(docs: DataFrame, length: int = 200) -> DataFrame:
    """What is left of ``docs(doc_id, text)``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Texts are UTF-8 bytes, null counts as empty. A byte goes if a string of
    ``length`` bytes that covers it also starts anywhere else, judged on the
    texts as given; matches do not cross documents. Repeated rows count as two
    places and so lose all of a long text; null ids are kept; an empty table
    gives no rows; extra columns are ignored.
    """
    rows = with_row_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "rid")
    placed = rows.repartition(partitions(docs.sparkSession), "rid")
    spans = repeated_spans(placed, length=length)

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, found in zip(batch.column(0).to_pylist(), byte_values(batch.column(1)), batch.column(2).to_pylist()):
                runs = merged(found)
                rest = keep_rest(text, runs)
                out.append((doc, len(text), len(text) - len(rest), len(runs), hashlib.sha256(rest).hexdigest()))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return placed.join(spans, "rid", "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` with repeated byte strings taken out of ``text``; characters cut in half go too; other columns stay.

    Needs columns ``doc_id`` and ``text``; every row stays, in no order. A null
    text stays null, an empty one empty; repeated rows and rows with a null id
    count as places of their own, so of repeated rows every long string goes
    from each; columns of any other name are kept as they are; an empty table
    gives no rows.
    """

    @F.pandas_udf("string")
    def rest(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, f in zip(texts, found):
            runs = merged(f)
            out.append(keep_rest(t.encode(), runs).decode("utf-8", "ignore") if runs else t)
        return pd.Series(out, dtype=object)

    rid, spans = fresh(docs, "rid", "spans")
    placed = with_row_ids(docs, rid).repartition(partitions(docs.sparkSession), rid)
    found = repeated_spans(placed, "text", rid, length).select(F.col("rid").alias(rid), F.col("spans").alias(spans))
    return placed.join(found, rid, "left").withColumn("text", rest("text", spans)).select(*docs.columns)
