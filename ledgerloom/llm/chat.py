"""Chat formatting with masks aligned to offsets.

Conversations are rendered whole: control tokens open a turn, end its role and
end its text, and control strings inside texts are escaped reversibly. The text
is encoded once; token ends in bytes come from the lengths of the tokens, and
the sorted spans of the turns to be learned are intersected with the sorted
token spans by binary search. Control tokens are never merged with text, so a
token never covers text of two turns.

Turns are sorted by range over the cluster, so that a conversation of any length
is spread over tasks; it is rendered in parts that end with a turn.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import partitions

START, ROLE_END, END = CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
#: Characters of a part, about; a longer conversation has several.
PART = 131_072
#: Characters of a text that take part in the choice of ranges.
PREFIX = 64

ORDER = ["conv_id", "turn", "role", "prefix"]
FORMATTED = "conv_id long, turn long, role string, prefix string, part long, whole boolean, formatted string, ids array<int>, loss array<boolean>"


def escaped(text: Column) -> Column:
    """One more backslash between ``<`` and ``|``, so that no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


@functools.lru_cache(maxsize=4)
def chat_encoding(path: str):
    """The vocabulary with the control tokens after its last id, and the bytes of every id."""
    import tiktoken

    ranks, special = tokens.vocabulary(path)
    first = max([*ranks.values(), *special.values()]) + 1
    controls = {c: first + i for i, c in enumerate(CONTROLS)}
    spoken = [b""] * (first + len(CONTROLS))
    for token, i in ranks.items():
        spoken[i] = token
    for token, i in (special | controls).items():
        spoken[i] = token.encode()
    return tiktoken.Encoding("chat", pat_str=tokens.SPLIT, mergeable_ranks=ranks, special_tokens=controls), spoken, np.array([len(b) for b in spoken], np.int64)


def encode(path: str, rendered: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a rendered text and the byte offset at which each token ends."""
    encoding, _, lengths = chat_encoding(path)
    ids = encoding.encode_to_numpy(rendered, allowed_special=set(CONTROLS)).astype(np.int64)
    return ids, np.cumsum(lengths[ids])


def mask(ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each token covers a byte of one of the sorted spans: its first and last token are found by binary search."""
    out = np.zeros(len(ends) + 1, np.int32)
    if spans:
        s = np.array(spans, np.int64)
        s = s[s[:, 1] > s[:, 0]]
        first, last = np.searchsorted(ends, s[:, 0], "right"), np.searchsorted(ends, s[:, 1], "left")
        np.add.at(out, first, 1)
        np.add.at(out, last + 1, -1)
    return np.cumsum(out[:-1]) > 0


def _format(path: str, learned: tuple[str, ...]):
    """Rendered and encoded parts of the conversations of a partition, whose rows are sorted."""

    def run(batches):
        key = first = None
        begun, several, part = True, False, 0  # at the edges of a partition a conversation may go on elsewhere
        pieces: list[str] = []
        spans: list[tuple[int, int]] = []
        size = chars = 0
        out: list[tuple] = []
        weight = 0

        def close(whole: bool):
            nonlocal pieces, spans, size, chars, part, weight
            text = "".join(pieces)
            ids, ends = encode(path, text)
            out.append((*first, part, whole, text, ids.astype(np.int32), mask(ends, spans)))
            weight += len(text)
            pieces, spans, size, chars, part = [], [], 0, 0, part + 1

        def table():
            nonlocal out, weight
            cols = list(zip(*out))
            lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(v) for v in c])], pa.int32()), pa.array(np.concatenate(c), t)) for c, t in ((cols[7], pa.int32()), (cols[8], pa.bool_()))]
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string())
            batch = pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, types)], *lists], names=[c.split()[0] for c in FORMATTED.split(", ")])
            out, weight = [], 0
            return batch

        for batch in batches:
            for conv, turn, role, prefix, said_by, text in zip(*(batch.column(j).to_pylist() for j in range(6))):
                if first is not None and conv != key:
                    close(not begun and not several)
                    begun = several = False
                elif chars >= PART:
                    close(False)
                    several = True
                if not pieces:
                    first = (conv, turn, role, prefix)
                key = conv
                head, body = f"{START}{said_by}{ROLE_END}", text
                low = size + len(head.encode())
                size = low + len(body.encode()) + len(END)
                if role in learned:
                    spans.append((low, size - len(END)))
                pieces += [head, body, END]
                chars += len(head) + len(body) + len(END)
                if weight >= 8 * PART:
                    yield table()
        if first is not None:
            close(False)
        if out:
            yield table()

    return run


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """Turns with escaped roles and texts, sorted by conversation and turn; ties by role, then text."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.substring(text, 1, PREFIX).alias("prefix"), text.alias("text"))
    placed = rows.repartitionByRange(partitions(conversations.sparkSession), *ORDER)
    return placed.sortWithinPartitions(*ORDER, "text").select(*ORDER, escaped(F.col("role")).alias("said_by"), escaped(F.col("text")).alias("body"))


def format_conversations(conversations: DataFrame, learned: tuple[str, ...] = ("assistant",), path: str | None = None) -> DataFrame:
    """Rendered parts of ``conversations(conv_id, turn, role, text)``: ``formatted, ids, loss``.

    ``loss`` tells for each token whether it belongs to a text of a ``learned``
    role; control tokens never do. ``whole``: the part is known to be its whole
    conversation. Other parts of a conversation follow each other by ``turn,
    role, prefix, part``, those of its first turn.

    Rows by turn, null first; equal turns by role, then by text; repeated rows
    are turns of their own. A null text is empty, a null role is the empty role;
    rows with a null conv_id are one conversation. Very long texts stay whole. An
    empty table gives no rows; extra columns are ignored.
    """
    path = path or tokens.vocabulary_path()
    return turns_in_order(conversations).mapInArrow(_format(path, learned), FORMATTED)


_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(ROLE_END) + "(.*?)" + re.escape(END), re.S)
READ = "conv_id long, turn long, role string, prefix string, part long, n_turns long, loss_chars long, formatted_chars long, turns_sha256 string, loss_sha256 string, turns binary, learned binary"


def _read_back(path: str):
    """Counts of each formatted part, and digests of whole conversations or what the digests are taken of."""
    _, spoken, _ = chat_encoding(path)

    def run(batches):
        for batch in batches:
            rows = []
            for *order, whole, ids, loss in zip(*(batch.column(j).to_pylist() for j in (0, 1, 2, 3, 4, 5)), *([x.values.to_numpy(zero_copy_only=False) for x in batch.column(j)] for j in (7, 8))):
                said = [spoken[i] for i in ids.tolist()]
                text = b"".join(said).decode()
                turns = [(unescaped(r), unescaped(t)) for r, t in _TURN.findall(text)]
                edge = np.flatnonzero(np.diff(np.r_[False, loss, False].astype(np.int8)))
                learned = "".join(unescaped(b"".join(said[a:b]).decode()) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()))
                read, heard = "".join(f"{r}\n{t}\n" for r, t in turns).encode(), learned.encode()
                digests = (hashlib.sha256(read).hexdigest(), hashlib.sha256(heard).hexdigest(), None, None) if whole else (None, None, read, heard)
                rows.append((*order, len(turns), len(learned), len(text), *digests))
            types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            fields = [c.split() for c in READ.split(", ")]
            cols = list(zip(*rows)) if rows else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])

    return run


def digests(conversations: DataFrame, learned: tuple[str, ...] = ("assistant",), path: str | None = None) -> DataFrame:
    """What :func:`format_conversations` wrote, read back from its ids and masks.

    Per conversation: ``conv_id, n_turns, turns_sha256`` (role, line feed, text,
    line feed of each turn), ``loss_chars, loss_sha256`` (all text under the
    mask, unescaped) and ``formatted_chars``. A conversation in several parts is
    digested from a stream of them, part by part.
    """
    path = path or tokens.vocabulary_path()
    write, read = _format(path, learned), _read_back(path)
    parts = turns_in_order(conversations).mapInArrow(lambda batches: read(write(batches)), READ)
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def join(batches):
        key, state = None, None

        def done():
            n, chars, formatted, a, b = state
            return (key, n, a if isinstance(a, str) else a.hexdigest(), chars, b if isinstance(b, str) else b.hexdigest(), formatted)

        def table(rows):
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            cols = list(zip(*rows)) if rows else [[]] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            rows = []
            for conv, n, chars, formatted, a, b, turns, heard in zip(*(batch.column(j).to_pylist() for j in (0, *range(5, 12)))):
                if state is None or conv != key:
                    if state is not None:
                        rows.append(done())
                    key, state = conv, [0, 0, 0, a or hashlib.sha256(), b or hashlib.sha256()]
                state[0], state[1], state[2] = state[0] + n, state[1] + chars, state[2] + formatted
                if a is None:
                    state[3].update(turns)
                    state[4].update(heard)
            yield table(rows)
        if state is not None:
            yield table([done()])

    placed = parts.repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions(*ORDER, "part")
    return placed.mapInArrow(join, schema)
