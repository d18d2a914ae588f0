"""Packing of token sequences by best-fit decreasing.

Documents longer than a window are first cut into full windows; each of those
is a sequence of its own. The rests are packed longest first, each into the
open window with the least sufficient room, found in a segment tree over
remaining capacities. Only piece descriptors are shuffled, never ids; they are
dealt by hash into groups of bounded size, each packed by itself, so the
padding lost to grouping is at most a few windows in some ten thousand.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encode, vocabulary_path

WINDOW = 1024
#: Documents in a packing group, on average.
GROUP = 40_000


class CapacityTree:
    """Segment tree over remaining capacities: counts open windows, finds the tightest that holds a length."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def push(self, room: int, window: int) -> None:
        self.open[room].append(window)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def pop_tightest(self, length: int) -> tuple[int, int] | None:
        """Room and number of the open window with the least room of at least ``length``."""
        count, node = self.count, length + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length (1 to ``window``)."""
    tree, used = CapacityTree(window), 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.pop_tightest(n) if n < window else None
        if found is None:
            room, number = window, used
            used += 1
        else:
            room, number = found
        bins[i], offsets[i] = number, window - room
        if room > n:
            tree.push(room - n, number)
    return bins, offsets


def pieces(docs: DataFrame, path: str | None = None, end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """Full windows and the rest of each document's ids: ``doc_id, start, length, ids_crc32, doc_tokens``."""
    path = path or vocabulary_path()

    def run(batches):
        for piece in (batch.slice(at, 1000) for batch in batches for at in range(0, batch.num_rows, 1000)):
            rows: list[tuple] = []
            for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                ids = np.append(encode(path, text or "").astype("<u4"), np.array([end_id], "<u4"))
                raw, n = ids.tobytes(), len(ids)
                for start in range(0, n, window):
                    length = min(window, n - start)
                    rows.append((doc, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, path: str | None = None, end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into windows: one row per piece with ``sequence_id`` and ``offset``.

    A null or empty text is the end id alone; repeated rows are packed as
    separate documents; a null doc_id is kept; an empty table gives no rows;
    extra columns are ignored. Pieces of a window lie gapless from offset 0.
    """
    groups = max(1, -(-docs.count() // GROUP))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = best_fit_decreasing(pdf["length"].to_numpy(), window)
        return pdf.assign(sequence_id=pdf["grp"].astype("int64") * (1 << 36) + bins, offset=offsets).drop(columns="grp")

    # by content and partition, so that repeated rows and null ids are spread as well
    spread = F.xxhash64("doc_id", "start", "ids_crc32", F.spark_partition_id())
    dealt = pieces(docs, path, end_id, window).withColumn("grp", F.pmod(spread, F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
