"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents as one stream, cut into blocks
of 256. A block stores its minimum, a bit width chosen at a percentile of the
differences to the minimum, the differences packed at that width, and the few
that do not fit in an exception list of positions and values. The footer
indexes where blocks start and where documents begin, so a reader can seek.

Layout (little-endian): ``PFR1``; blocks; footer = block offsets u64[], doc ids
i64[], doc starts u64[]; trailer = blocks u64, docs u64, ids u64, ``PFR1``.
A block: minimum u32, count u16, exceptions u16, width u8, packed differences,
exception positions u8[], exception values u32[].
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, shared_dir
from .tokens import encode, vocabulary_path

BLOCK, MAGIC = 256, b"PFR1"
#: Share of a block's differences that must fit the packed width.
PERCENTILE = 0.9
HEAD = struct.Struct("<IHHB")
TAIL = struct.Struct("<QQQ4s")


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2**width as bytes; width even, at most 16; four values make width/2 bytes."""
    if not width:
        return np.zeros((len(values), 0), np.uint8)
    quads = values.reshape(len(values), -1, 4).astype("<u8")
    word = quads[:, :, 0].copy()
    for j in (1, 2, 3):
        word |= quads[:, :, j] << np.uint64(j * width)
    return np.ascontiguousarray(word).view(np.uint8).reshape(len(values), -1, 8)[:, :, : width // 2].reshape(len(values), -1)


def unpack_bits(raw: np.ndarray, width: int) -> np.ndarray:
    """Inverse of :func:`pack_bits` for rows of ``BLOCK`` values."""
    if not width:
        return np.zeros((len(raw), BLOCK), np.uint32)
    wide = np.zeros((len(raw), BLOCK // 4, 8), np.uint8)
    wide[:, :, : width // 2] = raw.reshape(len(raw), BLOCK // 4, width // 2)
    word = wide.reshape(len(raw), -1).view("<u8")
    mask = np.uint64((1 << width) - 1)
    return np.stack([(word >> np.uint64(j * width)) & mask for j in range(4)], axis=2).reshape(len(raw), BLOCK).astype(np.uint32)


def encode_blocks(ids: np.ndarray) -> tuple[list[bytes], list[int]]:
    """Blocks of a run of ids, and their sizes in bytes; the last block is padded with its minimum."""
    if not len(ids):
        return [], []
    short = -len(ids) % BLOCK
    counts = np.full((len(ids) + short) // BLOCK, BLOCK)
    counts[-1] -= short
    x = np.append(ids.astype(np.uint32), np.full(short, ids[-(BLOCK - short) :].min() if short else 0, np.uint32)).reshape(-1, BLOCK)
    low = x.min(1)
    diff = x - low[:, None]
    at = np.partition(diff, int(PERCENTILE * (BLOCK - 1)), axis=1)[:, int(PERCENTILE * (BLOCK - 1))]
    width = np.minimum(16, (np.ceil(np.log2(at.astype(float) + 1)).astype(int) + 1) // 2 * 2)
    odd = diff >> width[:, None].astype(np.uint32) > 0
    packed: dict[int, bytes] = {}
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        body = pack_bits(np.where(odd[rows], 0, diff[rows]), w)
        packed.update(zip(rows.tolist(), (r.tobytes() for r in body)))
    r, c = np.nonzero(odd)
    values, edge = diff[r, c].astype("<u4"), np.searchsorted(r, np.arange(len(x) + 1))
    positions, out = c.astype(np.uint8), []
    for i, (m, n, w) in enumerate(zip(low.tolist(), counts.tolist(), width.tolist())):
        a, b = edge[i], edge[i + 1]
        out.append(HEAD.pack(m, n, b - a, w) + packed[i] + positions[a:b].tobytes() + values[a:b].tobytes())
    return out, [len(b) for b in out]


def decode_blocks(raw: bytes) -> np.ndarray:
    """Ids of a run of whole blocks."""
    at, heads, bodies, patches = 0, [], [], []
    while at < len(raw):
        low, n, odd, width = HEAD.unpack_from(raw, at)
        at += HEAD.size
        size = width * BLOCK // 8
        bodies.append((at, size))
        at += size
        if odd:
            where = np.frombuffer(raw, np.uint8, odd, at)
            patches.append((len(heads), where, np.frombuffer(raw, "<u4", odd, at + odd)))
        at += 5 * odd
        heads.append((low, n, width))
    if not heads:
        return np.empty(0, np.uint32)
    h = np.array(heads, np.int64)
    out = np.empty((len(h), BLOCK), np.uint32)
    for w in np.unique(h[:, 2]).tolist():
        rows = np.flatnonzero(h[:, 2] == w)
        body = b"".join(raw[a : a + s] for a, s in (bodies[i] for i in rows))
        out[rows] = unpack_bits(np.frombuffer(body, np.uint8).reshape(len(rows), -1), w)
    for i, where, values in patches:
        out[i, where] = values
    out += h[:, :1].astype(np.uint32)
    if (h[:, 1] == BLOCK).all():
        return out.ravel()
    return out[np.arange(BLOCK) < h[:, 1:2]]


class Writer:
    """Streams documents into one file; holds at most ``RUN`` ids and the index."""

    RUN = 256 * BLOCK

    def __init__(self, sink) -> None:
        self.sink, self.held, self.n_held = sink, [], 0
        self.doc_ids: list[int] = []
        self.starts: list[int] = []
        self.blocks: list[int] = []
        self.at, self.ids = len(MAGIC), 0
        sink.write(MAGIC)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.starts.append(self.ids)
        self.held.append(ids)
        self.ids += len(ids)
        self.n_held += len(ids)
        if self.n_held >= self.RUN:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        blocks, sizes = encode_blocks(ids[:whole])
        self.sink.write(b"".join(blocks))
        self.blocks.extend((self.at + np.r_[0, np.cumsum(sizes)][:-1]).astype(np.int64).tolist() if sizes else [])
        self.at += sum(sizes)
        self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        for x, kind in ((self.blocks, "<u8"), (self.doc_ids, "<i8"), (self.starts, "<u8")):
            self.sink.write(np.array(x, kind).tobytes())
        self.sink.write(TAIL.pack(len(self.blocks), len(self.doc_ids), self.ids, MAGIC))
        self.sink.close()


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if ":" in folder else (pafs.LocalFileSystem(), folder)


def read_documents(folder: str, name: str):
    """Yield ``(doc_id, start in the file, ids)`` of each document of a file, a run of blocks at a time."""
    store, base = filesystem(folder)
    with store.open_input_file(f"{base}/{name}") as f:
        size = f.size()
        n_blocks, n_docs, n_ids, magic = TAIL.unpack(f.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is not a token file")
        foot = size - TAIL.size - 8 * (n_blocks + 2 * n_docs)
        index = f.read_at(8 * (n_blocks + 2 * n_docs), foot)
        blocks = np.append(np.frombuffer(index, "<u8", n_blocks), foot).astype(np.int64)
        docs, starts = np.frombuffer(index, "<i8", n_docs, 8 * n_blocks), np.frombuffer(index, "<u8", n_docs, 8 * (n_blocks + n_docs)).astype(np.int64)
        ends = np.append(starts[1:], n_ids)
        held, first, k = np.empty(0, np.uint32), 0, 0
        for b in range(0, n_blocks, 256):
            stop = min(b + 256, n_blocks)
            held = np.append(held, decode_blocks(f.read_at(int(blocks[stop] - blocks[b]), int(blocks[b]))))
            while k < n_docs and ends[k] <= first + len(held):
                yield int(docs[k]), int(starts[k]), held[starts[k] - first : ends[k] - first]
                k += 1
            keep = (starts[k] if k < n_docs else n_ids) - first
            held, first = held[keep:], first + keep


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write ids of ``docs(doc_id, text)`` in ascending doc_id order; returns the manifest ``shard, name, n_docs, n_ids``.

    A null or empty text is the end id alone. Rows with a null doc_id are left
    out; repeated ids are written as separate documents (ordered by text). Each
    attempt of a task writes its own file; the manifest, which is
    checkpointed, names that of the attempt that succeeded.
    """
    path = path or vocabulary_path()
    n = partitions(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        writer, name = None, f"part-{task.partitionId():06d}-{task.taskAttemptId()}.pfr"
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                writer = writer or Writer(store.open_output_stream(f"{base}/{name}"))
                writer.add(doc, np.append(encode(path, text or ""), np.array([end_id], np.uint32)))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int64()), "name": [name], "n_docs": pa.array([len(writer.doc_ids)], pa.int64()), "n_ids": pa.array([writer.ids], pa.int64())})

    ordered = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ordered.mapInArrow(run, "shard long, name string, n_docs long, n_ids long"))


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Documents of the files: ``doc_id, start, n_tokens, ids_crc32``; start counts over all files in order."""
    based = manifest.withColumn("base", F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "name", F.coalesce("base", F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                rows: list[tuple] = []
                for doc, start, ids in read_documents(folder, name):
                    rows.append((doc, base + start, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes())))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return based.repartition(partitions(manifest.sparkSession), "shard").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def round_trip(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write token files into a new folder of the shared directory and read them back."""
    folder = f"{shared_dir(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(docs, folder, path, end_id), folder)
