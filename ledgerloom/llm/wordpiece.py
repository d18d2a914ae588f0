"""Word-piece token counts by a linear longest-match automaton.

The vocabulary trie gets failure links: where no arc continues, the automaton
pops the tokens that greedy longest match would emit and goes on from the rest
of what it has read. Only their number is kept (precomputed per node), so a
word's length is found in one pass over its bytes, without building a piece.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values
from .tokens import vocabulary, vocabulary_path

#: Words a task remembers before it starts afresh.
MEMO = 400_000


class Automaton:
    """Counts greedy longest-match pieces: ``initial`` pieces begin a word, ``inner`` ones continue it."""

    def __init__(self, initial, inner) -> None:
        self.arcs: list[dict[int, int]] = [{}, {}]  # 0: root of first pieces, 1: root of inner pieces
        token = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                node = root
                for c in piece:
                    nxt = self.arcs[node].get(c)
                    if nxt is None:
                        nxt = self.arcs[node][c] = len(self.arcs)
                        self.arcs.append({})
                        token.append(False)
                    node = nxt
                if node > 1:
                    token[node] = True
        self.fail, self.popped = [-1] * len(self.arcs), [0] * len(self.arcs)
        level = [0, 1]
        while level:
            after = []
            for u in level:
                for c, v in self.arcs[u].items():
                    after.append(v)
                    if token[v]:
                        self.fail[v], self.popped[v] = 1, 1
                        continue
                    z, n = self.fail[u], self.popped[u]
                    while z >= 0 and c not in self.arcs[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.arcs[z][c], n
            level = after

    def count(self, word: bytes) -> int:
        """Pieces of a word; 0 if no sequence of greedy matches covers it."""
        arcs, fail, popped, node, n = self.arcs, self.fail, self.popped, 0, 0
        for c in word:
            while c not in arcs[node]:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = arcs[node][c]
        while node != 1:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return 0
        return n


@functools.lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """Of a byte-level vocabulary: tokens that follow a blank begin words, the others continue them."""
    ranks, _ = vocabulary(path)
    return Automaton([t[1:] for t in ranks if t[:1] == b" " and len(t) > 1], [t for t in ranks if t[:1] != b" "])


class Memo(dict):
    def __init__(self, count) -> None:
        self.count = count

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        out = self[word] = self.count(word)
        return out


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Word-piece lengths of ``docs(doc_id, text)``: ``doc_id, n_words, n_tokens, n_unknown``.

    Words are maximal runs without ASCII blanks of the text with A-Z lower-cased;
    a word that the vocabulary cannot cover is one unknown token. A null text
    counts as empty (zeros); repeated rows and null ids are kept; extra columns
    are ignored; an empty table gives no rows.
    """
    path = path or vocabulary_path()

    def run(batches):
        memo = Memo(automaton(path).count)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), byte_values(batch.column(1))):
                found = list(map(memo.__getitem__, text.lower().split()))
                unknown = found.count(0)
                rows.append((doc, len(found), sum(found) + unknown, unknown))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
