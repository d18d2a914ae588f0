"""Data sources of delimited files: bank statements to read, declarations to write.

``spark.dataSource.register`` both (:func:`register`), then use the formats
``statement`` and ``declaration``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import csv
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes read at once; bytes of a partition by default, and what opening a file counts for.
CHUNK, PARTITION, OPENING = 1 << 20, 64 << 20, 1 << 20
#: Rows of a batch.
ROWS = 8192


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Ranges(InputPartition):
    """Byte ranges of files: ``(path within its file system, start, end, size of the file)``."""

    ranges: list[tuple[str, int, int, int]]


class StatementReader(DataSourceReader):
    """Lines that begin in a range of bytes; the delimiter follows the first line of the file, whichever range is read."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.head = int(options["head"]) if "head" in options else None
        self.size = int(options.get("maxPartitionBytes", PARTITION))

    def partitions(self) -> list[Ranges]:
        store, base = filesystem(self.path)
        info = store.get_file_info(base)
        files = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(base, recursive=True))
        named = sorted((f.path, f.size) for f in files if f.type == pafs.FileType.File and f.base_name.lower().endswith((".csv", ".txt")) and f.base_name[0] not in "._")
        out, held, weight = [], [], 0
        for path, size in named:
            end = min(size, CHUNK) if self.head is not None else size
            for start in range(0, max(end, 1), self.size):
                piece = (path, start, min(start + self.size, end), size)
                if held and weight + piece[2] - start + OPENING > self.size:
                    out.append(Ranges(held))
                    held, weight = [], 0
                held.append(piece)
                weight += piece[2] - start + OPENING
        return [*out, Ranges(held)] if held else out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(self.path)
        rows: list[tuple] = []
        for path, start, end, size in partition.ranges:
            with store.open_input_file(path) as f:
                mark = self._mark(f, size)
                for offset, row, line in self._lines(f, start, end, size):
                    if self.head is not None and row >= self.head:
                        break
                    if line:
                        rows.append((path, offset, row, mark, line))
                    if len(rows) >= ROWS:
                        yield self._batch(rows)
                        rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["file", "offset", "row", "mark", "line"])

    @staticmethod
    def _mark(f, size: int) -> str:
        held, at = b"", 0
        while b"\n" not in held and at < size:
            held += f.read_at(min(CHUNK, size - at), at)
            at = len(held)
        first = held.split(b"\n", 1)[0]
        return ";" if first.count(b";") >= first.count(b",") else ","

    @staticmethod
    def _lines(f, start: int, end: int, size: int) -> Iterator[tuple[int, int | None, str]]:
        """``(offset, row, line)`` of each line that begins in the range; rows are counted where the range starts the file."""
        at = start
        if start:  # the line that runs into the range belongs to the one before, unless it ends just there
            at, found = start - 1, -1
            while at < end and found < 0:
                piece = f.read_at(min(CHUNK, end - at), at)
                found = piece.find(b"\n")
                at += found + 1 if found >= 0 else len(piece)
            if found < 0:
                return
        row, held, offset = 0 if not start else None, b"", at
        while offset < end:
            piece = f.read_at(min(CHUNK, size - at), at) if at < size else b""
            at += len(piece)
            parts = (held + piece).split(b"\n")
            held = parts.pop() if piece else b""
            for raw in parts:
                if offset >= end:
                    return
                text = raw.decode("utf-8", "replace").replace("\r", "")
                yield offset, row, text.removeprefix("﻿") if not offset else text
                offset += len(raw) + 1
                row = row + 1 if row is not None else None
            if not piece:
                return


class StatementSource(DataSource):
    """Lines of statement files below a folder: ``file, offset, row, mark, line``.

    A file is cut into ranges of bytes, small files share a partition. ``offset``
    is where a line begins; ``row`` counts the lines of the first range and is
    null in the others. Options: ``head`` reads the first rows of every file
    only, ``maxPartitionBytes`` the size of a partition. Empty lines count and
    are left out; bytes that are no UTF-8 are replaced.
    """

    @classmethod
    def name(cls) -> str:
        return "statement"

    def schema(self) -> str:
        return "file string, offset long, row long, mark string, line string"

    def reader(self, schema: StructType) -> StatementReader:
        return StatementReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class DeclarationWriter(DataSourceArrowWriter):
    """One file for each run of rows with the same name; a manifest tells which files count."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = filesystem(self.path)
        store.create_dir(f"{base}/data", recursive=True)
        task, files, name, sink, stream = uuid.uuid4().hex[:12], [], None, None, None
        for batch in iterator:
            names = batch.column(0).to_pylist()
            edges = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]] + [len(names)]
            for a, b in zip(edges, edges[1:]):
                if names[a] != name:
                    if sink is not None:
                        sink.close()
                        stream.close()
                    name = names[a]
                    files.append(f"{name}.{len(files)}-{task}.csv")
                    stream = store.open_output_stream(f"{base}/data/{files[-1]}")
                    sink = csv.CSVWriter(stream, pa.schema(list(batch.schema)[1:]))
                sink.write_batch(batch.slice(a, b - a).select(batch.schema.names[1:]))
        if sink is not None:
            sink.close()
            stream.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = filesystem(self.path)
        store.create_dir(f"{base}/data", recursive=True)
        keep = sorted(f for m in messages if m is not None for f in m.files)
        draft = f"{base}/manifest-{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(draft) as f:
            f.write(json.dumps({"files": keep}).encode())
        store.move(draft, f"{base}/manifest.json")
        self._drop(set(keep))

    def abort(self, messages: list[Written | None]) -> None:
        store, base = filesystem(self.path)
        for f in {f for m in messages if m is not None for f in m.files}:
            store.delete_file(f"{base}/data/{f}")

    def _drop(self, keep: set[str]) -> None:
        """Files of earlier writes, and of tasks whose attempt did not count."""
        store, base = filesystem(self.path)
        for f in store.get_file_info(pafs.FileSelector(f"{base}/data")):
            if f.base_name not in keep:
                store.delete_file(f.path)


class DeclarationSink(DataSource):
    """Declaration files: the first column names the file, the others are its columns.

    Rows of one file must follow each other within a partition. A write
    replaces the earlier one as a whole, when its manifest is published.
    """

    @classmethod
    def name(cls) -> str:
        return "declaration"

    def writer(self, schema: StructType, overwrite: bool) -> DeclarationWriter:
        return DeclarationWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StatementSource)
    spark.dataSource.register(DeclarationSink)


def declared_files(path: str) -> list[str]:
    """Files of a declaration folder that its manifest names."""
    store, base = filesystem(path.rstrip("/"))
    with store.open_input_file(f"{base}/manifest.json") as f:
        return [f"{path.rstrip('/')}/data/{name}" for name in json.loads(f.read())["files"]]
