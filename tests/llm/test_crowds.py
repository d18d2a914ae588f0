"""Groups too large for one task, hot keys and several shards, with the bounds set low, against brute force."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import common, metricjoin, mih, simhash, suffix


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


def test_cells_dealt_as_chunk_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 40)
    monkeypatch.setattr(simhash, "CELL", 64)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 12)
    fps = np.array([int(b) ^ sum(1 << int(k) for k in rng.integers(0, 63, rng.integers(0, 4))) for b in base[rng.integers(0, 12, 300)]], np.int64)
    fps = np.unique(fps)
    rows = spark.createDataFrame([(i, [int(f)]) for i, f in enumerate(fps)], "id long, fp array<long>")
    sample = fps.view(np.uint64).reshape(-1, 1)
    parts = simhash.allocate(sample, 64, 4, len(fps))
    got = {r.id: r.root for r in common.components(simhash.links(rows, 1, 4, parts, len(fps))).collect()}
    want = classes(range(len(fps)), lambda a, b: (int(fps[a]) ^ int(fps[b])).bit_count() <= 4)
    assert {i: got.get(i, i) for i in range(len(fps))} == want and any(i != c for i, c in want.items())


def test_large_buckets_become_forests():
    rng = np.random.default_rng(6)
    fps = (rng.integers(0, 2**40, 400).astype(np.uint64) & np.uint64(0xFF00000000)).reshape(-1, 1)  # eight bits vary: many within two bits
    ids = np.arange(400)
    for small in (4, 100_000):
        edges = [e for a, b in simhash.cell_links(np.zeros(400, np.uint64), fps, ids, 8, 0, 2, 2, small) for e in zip(a.tolist(), b.tolist())]
        forest = common.Forest()
        for a, b in edges:
            forest.union(a, b)
        assert {i: forest.find(i) for i in range(400)} == classes(range(400), lambda a, b: int(np.bitwise_count(fps[a] ^ fps[b])[0]) <= 2)


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_crowd_dealt_as_chunk_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_DOCS", 8)
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    texts = {}
    for i in range(40):
        w = list(base)
        for k in range(rng.randint(0, 4)):
            w[rng.randrange(200)] = f"new{i}x{k}"
        texts[i] = " ".join(w)
    got = {r.doc_id: r.root for r in simhash.similar(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    assert got == classes(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))


def test_recall_at_the_threshold():
    """Pairs of sets of similarity 0.8 to 0.85 that the allocated probes bring together within the radius."""
    rng, found, pairs, words = np.random.default_rng(0), 0, 400, 4
    parts = simhash.allocate_similar(rng.integers(0, 2**63, (2000, words)).astype(np.uint64), 256, 100_000, 0.8)
    p = simhash.bit_error(0.8)
    radius = int(np.ceil(256 * p + 3.3 * np.sqrt(256 * p * (1 - p))))
    for _ in range(pairs):
        n = int(rng.integers(20, 300))
        common_ = int(np.ceil(n * 1.6 / 1.8))
        h = rng.integers(0, 2**64 - 1, 2 * n - common_, dtype=np.uint64)
        a, b = simhash.fingerprint(h[:n], words)[None], simhash.fingerprint(h[n - common_ :], words)[None]
        near = np.bitwise_count(a ^ b).sum() <= radius
        found += bool(near and any(int(np.bitwise_count(simhash.part_values(a, q) ^ simhash.part_values(b, q))[0]) <= t for q, t in parts))
    assert found >= 0.99 * pairs


def test_hot_minimisers_and_salts(spark, monkeypatch):
    """One passage in most documents, at the length of the query, with every minimiser of it hot."""
    monkeypatch.setattr(suffix, "SAMPLE", 10**9)
    monkeypatch.setattr(suffix, "SALTS", 3)
    monkeypatch.setattr(suffix, "CHUNK", 16)
    rng = random.Random(9)

    def filler(n):
        return "".join(rng.choice("abcdefghij") for _ in range(n))

    passage = filler(260)
    texts = {i: (filler(rng.randint(0, 40)) + passage + filler(rng.randint(0, 40)) if i % 4 else filler(300)) for i in range(160)}
    texts |= {200 + i: texts[1] for i in range(120)}
    seen = Counter(t[k : k + 200] for t in texts.values() for k in range(len(t) - 199))
    got = {r.doc_id: r.n_removed for r in suffix.digests(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 200).collect()}
    for i, t in texts.items():
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        assert got[i] == gone.sum(), i


def test_several_shards_and_split_cells(spark, monkeypatch):
    """Recall over several index cells and rerank shards; the answers come through the probes."""
    monkeypatch.setattr(mih, "SHARD", 100)
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(1500, 24)), rng.normal(size=(1, 24)) + 0.01 * rng.normal(size=(400, 24))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    search = mih.Search(df, 10)
    assert search.shards > 10 and search.bits < 16
    queries = search.rows.where("vec_id % 20 = 0")
    got: dict[int, set] = {}
    for r in search.nearest(queries).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:10].tolist()))
    assert all(len(v) == 10 for v in got.values()) and hits >= 0.9 * 10 * len(got)
    met = search.candidates(queries, search.reach, search.radius).agg(F.sum("met")).first()[0]
    assert 0 < met < mih.PARTS / 8 * len(got) * len(x)  # under an eighth of the index entries
    # without index rows nothing is found
    search.index = search.index.where("false")
    assert search.candidates(queries, search.reach, search.radius).count() == 0


def test_probes_are_the_weighted_ball():
    rng = np.random.default_rng(8)
    own, margin = rng.integers(0, 1 << 10, 5), rng.random((5, 10))
    for bits, prefix in ((10, 0), (7, 3)):
        q, value = mih.probed(own, margin, prefix, bits, 1.5)
        want = set()
        for i in range(5):
            for v in range(1 << bits):
                apart = (prefix << bits | v) ^ int(own[i])
                if sum(margin[i, b] for b in range(10) if apart >> b & 1) <= 1.5:
                    want.add((i, v))
        assert set(zip(q.tolist(), value.tolist())) == want


def test_metric_join_over_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(metricjoin, "HOMES", 30)
    monkeypatch.setattr(metricjoin, "PIVOTS", 3)
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(size=(200, 12)), np.ones((1, 12)) + 0.05 * rng.normal(size=(150, 12))])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in metricjoin.linked(df).collect()}
    want = classes(range(len(x)), lambda a, b: near[a, b])
    assert all(got[i].n_links == near[i].sum() and got[i].component_id == want[i] for i in range(len(x)))


def test_components_with_hot_centres(spark):
    rng = random.Random(4)
    edges = [(0, i) for i in range(1, 2000)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5, None), (7, 7)]
    got = {r.id: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    forest = common.Forest()
    for a, b in edges:
        if b is not None:
            forest.union(a, b)
    assert got == {i: forest.find(i) for i in list(forest.parent) if forest.find(i) != i}
