"""BPE encoding and decoding through a minimal acyclic transducer.

Frequent words of the corpus (counted over all of it) are compiled, with their
ids as output, into a minimal acyclic automaton with shared suffixes. Arcs
carry partial sums that add up to a word's number; the number selects its ids.
The automaton is a file that Spark hands to every executor once; its tasks map
the same file, so its pages are shared. Words it does not hold are merged
exactly.
"""

from __future__ import annotations

import functools
import hashlib
import mmap
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir
from .pfor import filesystem
from .tokens import encoding, vocabulary, vocabulary_path

#: Words compiled into the automaton, and the longest of them.
LEXICON_WORDS, LEXICON_CHARS = 32_768, 48
#: Words a task remembers before it starts afresh.
MEMO = 400_000
#: Words counted before a task hands its counts on.
COUNT_WORDS = 300_000

SPACE = r"\p{White_Space}"
SPLIT = regex.compile(rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}++| ?\p{{N}}++| ?[^{SPACE}\p{{L}}\p{{N}}]++|{SPACE}++\Z|{SPACE}+(?!\P{{White_Space}})|{SPACE}")


class Transducer:
    """Minimal acyclic automaton of byte strings numbered in sorted order."""

    def __init__(self, raw) -> None:
        view = memoryview(raw)
        states, arcs, words, ids = np.frombuffer(view[:16], "<u4").tolist()
        at, parts = 16, []
        for kind, n in (("<u4", states + 1), ("<u4", arcs), ("<u4", arcs), ("<u4", words + 1), ("<u4", ids)):
            parts.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.target, self.skip, self.id_start, self.ids = parts
        self.final, self.raw, self.labels = view[at : at + states], raw, at + states
        self.size = words

    def number(self, word: bytes) -> int:
        """The word's number, or -1."""
        state, out, first, find, base = 0, 0, self.first, self.raw.find, self.labels
        for i in range(len(word)):
            a = find(word[i : i + 1], base + first[state], base + first[state + 1]) - base
            if a < 0:
                return -1
            out += self.skip[a]
            state = self.target[a]
        return out if self.final[state] else -1

    def lookup(self, word: bytes) -> list[int] | None:
        k = self.number(word)
        return None if k < 0 else self.ids[self.id_start[k] : self.id_start[k + 1]].tolist()


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """Build the automaton incrementally from sorted words, merging equal right languages as they are completed."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]
    last = b""
    for word in sorted(words):
        common = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        for i in range(len(last), common, -1):
            done = path.pop()
            path[-1][1].append((last[i - 1], freeze(done)))
        for _ in word[common:]:
            path.append([False, []])
        path[-1][0] = True
        last = word
    for i in range(len(last), 0, -1):
        done = path.pop()
        path[-1][1].append((last[i - 1], freeze(done)))
    root = freeze(path[0])
    below = []  # words accepted from each state; targets come before their sources
    for final, arcs in states:
        below.append(int(final) + sum(below[t] for _, t in arcs))
    order = [root, *(s for s in range(len(states)) if s != root)]
    new = {s: i for i, s in enumerate(order)}
    first, target, skip, labels = [0], [], [], bytearray()
    for s in order:
        final, arcs = states[s]
        passed = int(final)
        for label, t in arcs:
            labels.append(label)
            target.append(new[t])
            skip.append(passed)
            passed += below[t]
        first.append(len(target))
    id_start, ids = [0], []
    for word in sorted(words):
        ids.extend(words[word])
        id_start.append(len(ids))
    head = np.array([len(order), len(target), len(words), len(ids)], "<u4")
    return b"".join([head.tobytes(), *(np.array(x, "<u4").tobytes() for x in (first, target, skip, id_start, ids)), bytes(states[s][0] for s in order), bytes(labels)])


def count_words(docs: DataFrame) -> DataFrame:
    """Counts ``(word, n)`` of blank-separated words over all texts; tasks hand on partial counts."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update((text or "").split())
                if len(counts) >= COUNT_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
                    counts = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> bytes:
    """Compile the ``words`` most frequent words of the corpus, as they stand after a blank and without one."""
    top = count_words(docs).where(F.length("word") <= LEXICON_CHARS).orderBy(F.desc("n"), "word").limit(words).select("word").toArrow().column(0).to_pylist()
    core, entries = encoding(path)._core_bpe, {}
    for word in top:
        for piece in {*SPLIT.findall(word), *SPLIT.findall(f" {word}")}:
            raw = piece.encode()
            entries[raw] = list(core.encode_single_piece(raw))
    return compile_lexicon(entries)


def hand_out(spark: SparkSession, raw: bytes) -> str:
    """Write the automaton into the shared folder and let Spark copy it to every executor, later ones too; returns the file's name."""
    folder, name = shared_dir(spark).rstrip("/"), f"lexicon-{uuid.uuid4().hex}.bin"
    store, base = filesystem(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/{name}") as f:
        f.write(raw)
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


@functools.lru_cache(maxsize=2)
def mapped(name: str) -> Transducer:
    """Memory-map an automaton that Spark handed out."""
    with open(SparkFiles.get(name), "rb") as f:
        return Transducer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


class Codec(dict):
    """Pieces of text to ``(number of ids, decimal ids, decoded bytes)``; remembers a bounded number."""

    def __init__(self, path: str, lexicon: Transducer) -> None:
        self.core, self.lexicon = encoding(path)._core_bpe, lexicon
        ranks, self.special = vocabulary(path)
        self.token = {i: t for t, i in ranks.items()} | {i: s.encode() for s, i in self.special.items()}

    def ids(self, piece: str) -> list[int]:
        raw = piece.encode()
        found = self.lexicon.lookup(raw)
        return found if found is not None else list(self.core.encode_single_piece(raw))

    def __missing__(self, piece: str) -> tuple[int, str, bytes]:
        if len(self) >= MEMO:
            self.clear()
        ids = [self.special[piece]] if piece in self.special else self.ids(piece)
        out = self[piece] = (len(ids), ",".join(map(str, ids)), b"".join(map(self.token.__getitem__, ids)))
        return out

    def split(self, text: str) -> list[str]:
        """Pieces in order; special tokens in the text stand for themselves."""
        if not any(s in text for s in self.special):
            return SPLIT.findall(text)
        cut = regex.split("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")", text)
        return [p for part in cut for p in ([part] if part in self.special else SPLIT.findall(part))]


def encode_decode(docs: DataFrame, path: str | None = None, words: int = LEXICON_WORDS) -> DataFrame:
    """Encode and decode ``docs(doc_id, text)``: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    ``ids_sha256`` is of the decimal ids joined by commas, ``decoded_sha256`` of
    the text decoded from the ids. A null text counts as empty (no ids);
    repeated rows and null ids are kept; extra columns are ignored; an empty
    table gives no rows.
    """
    path = path or vocabulary_path()
    name = hand_out(docs.sparkSession, build(docs, path, words))

    def run(batches):
        codec = Codec(path, mapped(name))
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(map(codec.__getitem__, codec.split(text or "")))
                n, ids, raw = zip(*found) if found else ((), (), ())
                decoded = b"".join(raw).decode("utf-8", "replace").encode()
                rows.append((doc, sum(n), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            a = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(a[0], pa.int64()), pa.array(a[1], pa.int64()), pa.array(a[2], pa.string()), pa.array(a[3], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
