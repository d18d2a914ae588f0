"""The training-data operators against brute force, on small tables with nulls, copies, ties, long texts and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import langid, lexicon, metricjoin, mih, packing, pfor, rules, simhash, suffix, tokens, wordpiece

COLUMNS = "doc_id long, text string, lang string, source string, rank int, spans string, h string"


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéñß日'") for _ in range(rng.randint(1, 9))) for _ in range(400)]

    def text(k):
        return "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "\n", "  ", ". ", " 12 ", " "]) for _ in range(k))

    passage = text(80)
    texts = [text(rng.randint(1, 120)) for _ in range(n)]
    texts += [passage, text(30) + passage + text(20), passage[3:] + text(5), texts[0], texts[0], text(4000), None, "", " \n\t ", "one two", "A B c d", "a b C D", "x" * 900, "ab" * 400]
    long = text(150)
    for i in range(6):
        w = long.split(" ")
        w[10 + i] = f"edit{i}"
        texts.append(" ".join(w))
    texts.append("mark <|endoftext|> inside<|endoftext|>")
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 + 1, t, ["en", "fr", None][i % 3], f"s{i % 4}.example.com", i, "x", "y") for i, t in enumerate(corpus())]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def classes(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_suffix_digests(docs, texts):
    length = 80
    seen = Counter()
    raw = {i: t.encode() for i, t in texts.items()}
    for t in raw.values():
        seen.update(t[k : k + length] for k in range(len(t) - length + 1))
    got = {r.doc_id: r for r in suffix.digests(docs, length).collect()}
    assert got.keys() == raw.keys()
    for i, t in raw.items():
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()), i
    assert sum(r.n_removed for r in got.values()) > 0


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    for alphabet, n in ((2, 300), (4, 2000), (1, 50), (256, 1000)):
        t = rng.integers(0, alphabet, n).astype(np.uint8)
        raw = t.tobytes()
        got = suffix.suffix_array(t, n + 8)
        assert got.tolist() == sorted(range(n), key=lambda i: raw[i:])


def test_without_repeats_keeps_columns(docs):
    out = suffix.without_repeats(docs, 80)
    assert out.columns == docs.columns and out.count() == docs.count()


def library(text):
    from tokenizers import Tokenizer

    library.t = getattr(library, "t", None) or Tokenizer.from_file(tokens.vocabulary_path())
    return library.t.encode(text, add_special_tokens=False).ids


def test_encode_matches_library(texts):
    odd = ["", " ", "\n\n  x", "I'm they're 'S", "a\u0085b c", "\x1c\x1d x", "١٢٣ ½ ² ①", "  \t\n", "trailing  ", "é" * 300, "'" * 7 + "s", "　全角", "🙂🙂 ok", "a​b", "﻿"]
    for t in [*texts.values(), *odd]:
        assert tokens.encode(tokens.vocabulary_path(), t).tolist() == library(t), t[:40]


def test_packing(docs, texts):
    got = packing.pack(docs, end_id=0, window=64).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for i, rows in by_doc.items():
        ids = np.array([*library(texts[i]), 0], "<u4")
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(by_seq) <= total / 64 * 1.1 + 1


def test_best_fit_takes_tightest_window():
    lengths = np.array([6, 5, 4, 3, 2])
    bins, offsets = packing.best_fit_decreasing(lengths, 10)
    assert bins.tolist() == [0, 1, 0, 1, 1] and offsets.tolist() == [0, 0, 6, 5, 8]


def test_token_counts(docs, texts):
    ranks, _ = tokens.vocabulary(tokens.vocabulary_path())
    initial, inner = {t[1:] for t in ranks if t[:1] == b" "}, {t for t in ranks if t[:1] != b" "}

    def greedy(word):
        n, at, pieces = 0, 0, initial
        while at < len(word):
            size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pieces), 0)
            if not size:
                return 0
            n, at, pieces = n + 1, at + size, inner
        return n

    for r in wordpiece.token_counts(docs).collect():
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), texts[r.doc_id].encode()))
        found = [greedy(w) for w in words]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(found), sum(found) + found.count(0), found.count(0))


def test_automaton_small_vocabulary():
    rng = random.Random(3)
    for _ in range(200):
        initial = {bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 4))) for _ in range(4)}
        inner = {bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 4))) for _ in range(4)}
        a = wordpiece.Automaton(initial, inner)
        for _ in range(20):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 9)))
            n, at, pieces = 0, 0, initial
            while at < len(word):
                size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pieces), 0)
                if not size:
                    n = 0
                    break
                n, at, pieces = n + 1, at + size, inner
            assert a.count(word) == n


def slow_fingerprint(text, ngram):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    grams = [b" ".join(words[k : k + ngram]) for k in range(max(1, len(words) - ngram + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, texts):
    for parts in (None, [(list(range(k, k + 8)), 0) for k in range(0, 64, 8)]):
        got = {r.doc_id: r for r in simhash.near_duplicates(docs, 4, 1, 4, False, parts).collect()}
        fp = {i: slow_fingerprint(t, 4) for i, t in texts.items()}
        assert {i: r.fp[0] % 2**64 for i, r in got.items()} == fp
        want = classes(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
        assert {i: r.component_id for i, r in got.items()} == want
    assert any(i != c for i, c in want.items())


def test_allocation_covers_radius():
    sample = np.random.default_rng(0).integers(0, 2**63, (500, 1)).astype(np.uint64)
    for rows in (500, 10**6, 10**9):
        parts = simhash.allocate(sample, 64, 4, rows)
        assert sum(t + 1 for _, t in parts) >= 5 and len({b for p, _ in parts for b in p}) == sum(len(p) for p, _ in parts)


def test_similar_finds_near_copies(docs, texts):
    got = {r.doc_id: r.root for r in simhash.similar(docs, 0.8, 5).collect()}

    def shingles(t):
        w = re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()).split()
        return frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {i: shingles(t) for i, t in texts.items()}
    assert got == classes(sorted(sets), lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0)


def test_radius_beyond_thresholds_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.near_duplicates(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), radius=60).count()


def test_lexicon(docs, texts):
    got = {r.doc_id: r for r in lexicon.encode_decode(docs, words=50).collect()}
    for i, t in texts.items():
        ids = library(t)
        decoded = library.t.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()), t[:40]


def test_transducer_is_minimal_and_exact():
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["walking", "talking", "walked", "talked", "walks", "talks", "a", "é", ""])}
    t = lexicon.Transducer(lexicon.compile_lexicon(words))
    assert all(t.lookup(w) == ids for w, ids in words.items())
    assert all(t.lookup(w) is None for w in (b"walk", b"walkingx", b"b", "ê".encode()))
    assert len(t.final) < 20 and sorted(t.number(w) for w in words) == list(range(len(words)))


def test_language(docs, spark):
    rng = random.Random(5)
    kinds = {"aa": "abcab", "bb": "xyzxy"}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(5)) for _ in range(12)), k if i % 5 else None, f"h{i % 3}.{k}") for i, k in enumerate(["aa", "bb"] * 40)]
    rows += [(900, None, "aa", "h.aa"), (901, "", "bb", None), (902, "12 34", "aa", "h.aa"), (903, "x", None, "h0.bb")]
    out = {r.doc_id: r.language for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, host string"), declared=F.col("lang"), host=F.col("host")).collect()}
    assert all(out[i].lang == ["aa", "bb"][i % 2] and out[i].accepted for i in range(80))
    assert all(out[i].lang == "und" and not out[i].accepted for i in (900, 901, 902)) and out[903].lang == "bb"
    assert langid.identify(docs, declared=F.col("lang"), host=F.col("source")).columns == [*docs.columns, "language"]


def test_rules(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.6
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(words if good else [w + "###" for w in words]), 1))
        labels.append((i, int(good)))
    rows += [(1000, None, 1), (1001, "", 1), (1002, "x" * 100_000, 1)]
    out = rules.quality(spark.createDataFrame(rows, "doc_id long, text string, stats int"), spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, label int"), F.col("doc_id") % 3 == 1).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 400]
    assert np.mean([r.predicted == labels[r.doc_id][1] for r in held]) > 0.97


def vectors(spark, n=700, d=16):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(n, d))
    near = base[rng.integers(0, 40, 120)] + 0.1 * rng.normal(size=(120, d))
    x = np.vstack([base, near, np.repeat(base[:1], 60, 0)]).astype(np.float32)
    rows = [(i * 5, [float(v) for v in r], i % 4) for i, r in enumerate(x)]
    odd = [(100_000, None, 0), (100_020, [0.0] * d, 0), (100_040, [float("nan")] * d, 0), (100_060, [None] + [1.0] * (d - 1), 0), (100_080, [float("inf")] * d, 0)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int"), np.array([r[0] for r in rows]), x.astype(float)


def test_metric_join(spark):
    df, ids, x = vectors(spark)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    at = {int(i): k for k, i in enumerate(ids)}
    want = classes(sorted(at), lambda a, b: near[at[a], at[b]])
    for homes in (metricjoin.HOMES, 50):
        metricjoin.HOMES, before = homes, metricjoin.HOMES
        got = {r.vec_id: r for r in metricjoin.linked(df).collect()}
        metricjoin.HOMES = before
        assert len(got) == len(ids) + 5
        assert all(got[i].n_links == near[k].sum() and got[i].component_id == want[i] and got[i].kept == (want[i] == i) for i, k in at.items())
        assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in got if i >= 100_000)


def test_nearest(spark):
    df, ids, x = vectors(spark)
    got = {}
    for r in mih.nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append(r)
    queries = [k for k, i in enumerate(ids) if i % 20 == 0]
    assert got.keys() == {int(ids[k]) for k in queries}
    hits = 0
    for k in queries:
        s = x @ x[k]
        order = [j for j in np.lexsort((ids, -s)) if j != k][:20]
        rows = sorted(got[int(ids[k])], key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, 21))
        assert all(abs(r.score - s[r.vec_id // 5]) < 1e-9 for r in rows)
        hits += len({int(ids[j]) for j in order} & {r.vec_id for r in rows})
    assert hits / 20 / len(queries) >= 0.9


def test_nearest_few(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, [1.0, 2.0]), (7, [3.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in mih.nearest(df, F.col("vec_id") % 20 == 0, 20).collect())
    assert got == [(0, 1, 7), (0, 2, 20), (20, 1, 0), (20, 2, 7)] or got == [(0, 1, 20), (0, 2, 7), (20, 1, 0), (20, 2, 7)]


def test_token_files(docs, texts):
    got = {r.doc_id: r for r in pfor.round_trip(docs).collect()}
    at = 0
    for i in sorted(texts):
        ids = np.array([*library(texts[i]), 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for ids in (rng.integers(0, 50257, 10_000), rng.integers(0, 2**32, 777), np.zeros(256), np.array([5]), np.array([]), np.r_[np.full(300, 7), 2**32 - 1]):
        blocks, sizes = pfor.encode_blocks(ids.astype(np.uint32))
        assert sum(sizes) == len(b"".join(blocks)) and (pfor.decode_blocks(b"".join(blocks)) == ids).all()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], COLUMNS)
    vecs = spark.createDataFrame([], "vec_id long, embedding array<float>")
    labels = spark.createDataFrame([], "doc_id long, label int")
    results = [suffix.digests(docs), packing.pack(docs), wordpiece.token_counts(docs), simhash.near_duplicates(docs), lexicon.encode_decode(docs), langid.identify(docs, declared=F.col("lang")), rules.quality(docs, labels, F.lit(False)), metricjoin.linked(vecs), mih.nearest(vecs, F.col("vec_id") % 20 == 0), pfor.round_trip(docs)]
    assert [df.count() for df in results] == [0] * len(results)


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "same words here again and again " * 12), (1, "same words here again and again " * 12), (None, "short"), (2, None)], "doc_id long, text string")
    assert suffix.digests(docs).count() == 4 and packing.pack(docs).groupBy("doc_id").agg(F.max("doc_tokens")).count() == 3
    assert sorted(r.n_removed for r in suffix.digests(docs).collect())[:2] == [0, 0]
    assert pfor.round_trip(docs).count() == 3 and lexicon.encode_decode(docs).count() == 4 and wordpiece.token_counts(docs).count() == 4
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} == {1, 2}
