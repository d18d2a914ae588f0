"""Spans and digests at 200 bytes against brute force: crowds, texts over a piece, arrays over their size."""

import hashlib
import random
from collections import Counter

import numpy as np

from ledgerloom.llm import suffix


def brute(texts, length=200):
    """Removed bytes, runs and digest of what is left, from the set of all windows."""
    raw = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(hash(b[p : p + length]) for b in raw.values() for p in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, np.int32)
        for p in range(len(b) - length + 1):
            if seen[hash(b[p : p + length])] > 1:
                gone[p] += 1
                gone[min(p + length, len(b))] -= 1
        covered = np.cumsum(gone)[:-1] > 0
        edge = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
        kept = np.frombuffer(b, np.uint8)[~covered].tobytes()
        out[i] = (len(b), int(covered.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest())
    return out


def got(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digests(df, 200).collect()}


def filler(rng, n):
    return "".join(rng.choice("abcdefghij é") for _ in range(n))


def test_spans_and_digests_at_the_length_of_the_query(spark, monkeypatch):
    rng = random.Random(3)
    passages = [filler(rng, n) for n in (199, 200, 230, 500)]
    texts: dict = {i: "".join(filler(rng, rng.randint(0, 150)) + rng.choice([*passages, ""]) for _ in range(rng.randint(0, 4))) for i in range(120)}
    texts |= {500: None, 501: "", 502: texts[3], 503: "ab" * 400, 504: "x" * 1000}
    want = brute(texts)
    assert got(spark, texts) == want
    monkeypatch.setattr(suffix, "ARRAY", 2000)  # several arrays to a task
    assert got(spark, texts) == want
    monkeypatch.setattr(suffix, "CHUNK", 2)  # crowds as pairs of chunks
    assert got(spark, texts) == want
    monkeypatch.setattr(suffix, "PAIRED", 1)  # every crowd by its windows
    assert got(spark, texts) == want


def test_texts_over_a_piece(spark):
    """Two texts of over 2 MiB with a passage across the border of pieces, one inside, and one that repeats within a text."""
    rng = np.random.default_rng(5)
    long = ["".join(map(chr, rng.integers(97, 123, suffix.PIECE + 300_000))) for _ in range(2)]
    passage = "".join(map(chr, rng.integers(65, 91, 400)))
    at = suffix.PIECE - 150
    long[0] = long[0][:at] + passage + long[0][at:]
    long[1] = long[1][:77] + passage[:260] + long[1][77:1_000_000] + passage[100:] + long[1][1_000_000:]
    texts = {1: long[0], 2: long[1], 3: "short"}
    found = got(spark, texts)
    b = {i: t.encode() for i, t in texts.items()}
    assert found[1] == (len(b[1]), 400, 1, hashlib.sha256(b[1].replace(passage.encode(), b"")).hexdigest())
    assert found[2][:3] == (len(b[2]), 260 + 300, 2) and found[3][1] == 0


def test_work_is_linear_in_a_crowd(spark, monkeypatch):
    """One passage in new surroundings every time: what is compared grows with the documents and not with their square."""
    monkeypatch.setattr(suffix, "CHUNK", 64)
    monkeypatch.setattr(suffix, "PAIRED", 2)
    rng = random.Random(8)
    passage, rows = filler(rng, 230), []
    first = suffix.written
    monkeypatch.setattr(suffix, "written", lambda df, what: rows.append((what, (out := first(df, what)).count())) or out)
    sizes = []
    for n in (400, 1600):
        rows.clear()
        texts = {i: filler(rng, 60) + passage + filler(rng, 60) for i in range(n)}
        found = got(spark, texts)
        if n == 400:
            assert found == brute(texts)
        assert all(v[1] >= len(passage.encode()) for v in found.values())
        sizes.append(dict(rows)["windows"])
    assert sizes[1] < 4.3 * sizes[0]
