"""Chat masks, whitening and clustering against brute force."""

import hashlib
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from ledgerloom.llm import chat, clustering, mih, queries, tokens, whitening

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = c.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(tuple(r[n] for n in names) for r in df.collect())
    assert got == sorted(cur.fetchall()) and got


# chat formatting

ODD = ["", None, "<|", "<\\|", "<\\\\|im_end|>", "|>", "<", "\\|", "<|im_end|><|im_start|>assistant ok", "<|im_sep|>", "  \n\n lead", "tail \n", "é日本 😀", "a<|endoftext|>b", "...<|im_end|>", "<<||", "\u0000x", "<|im_start|>user<|im_sep|>hi<|im_end|>"]


def conversation_rows(seed=3):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(30), None]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "assistant", None, "a<|im_sep|>b"]), "".join(str(rng.choice(ODD) or "") for _ in range(rng.randint(0, 4))) if turn % 3 else rng.choice(ODD)))
    rows += [(5, None, "assistant", "no turn"), (6, 1, "assistant", "tie b"), (6, 1, "assistant", "tie a"), (6, 1, "assistant", "tie a"), (7, 99, "assistant", "long " * 300_000)]
    rows += [(77, t, "assistant" if t % 2 else "user", f"turn {t} " + "word " * 60) for t in range(2500)]
    return rows


def expected_digests(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda v: (v[0], v[1], v[2].encode(), v[3].encode()))
        learned = "".join(x for _, _, r, x in mine if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in mine)
        out[conv] = (len(mine), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, prefix string, part int").repartition(5)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(df).collect()}
    assert got == expected_digests(rows)
    parts = chat.format_conversations(df).collect()
    assert len([p for p in parts if p.conv_id == 77]) > 1
    assert chat.digests(df.limit(0)).collect() == [] and chat.format_conversations(df.limit(0)).collect() == []
    # the ids are those of the public library with the same control tokens
    from tokenizers import AddedToken, Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary_path())
    library.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in chat.CONTROLS])
    for p in parts:
        if len(p.formatted) < 50_000:
            encoding = library.encode(p.formatted, add_special_tokens=False)
            assert encoding.ids == p.ids
            assert len(p.loss) == len(p.ids)


def test_mask_is_the_intersection():
    rng = random.Random(5)
    for _ in range(300):
        ends = np.cumsum([rng.randint(1, 4) for _ in range(rng.randint(1, 25))])
        edges = sorted(rng.sample(range(int(ends[-1]) + 1), min(int(ends[-1]) + 1, 2 * rng.randint(0, 3))))
        spans = list(zip(edges[::2], edges[1::2]))
        starts = np.r_[0, ends[:-1]]
        want = [any(max(s, a) < min(e, b) for a, b in spans) for s, e in zip(starts, ends)]
        assert chat.mask(ends, spans).tolist() == want


# whitening


def exact_covariance(x):
    distinct = sorted(set(map(tuple, x)))
    n, d = len(distinct), len(distinct[0])
    s = [sum(v[i] for v in distinct) for i in range(d)]
    v = [[sum((Fraction(r[i]) - Fraction(s[i], n)) * (Fraction(r[j]) - Fraction(s[j], n)) for r in distinct) / n for j in range(d)] for i in range(d)]
    return n, s, np.array([[float(c) for c in row] for row in v])


def vectors_with_oddities(rng, n, d):
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=d) * np.linspace(0.2, 2, d)]) for i in range(n)]
    rows += [(n, rows[0][1]), (0, rows[0][1]), (None, rows[1][1]), (n + 1, [0.0] * d), (n + 2, None), (n + 3, [None] + [1.0] * (d - 1)), (n + 4, [float("nan")] * d), (n + 5, [float("inf")] + [0.0] * (d - 1)), (n + 6, [])]
    return rows


def test_whitening_against_exact_covariance(spark):
    rows = vectors_with_oddities(np.random.default_rng(1), 120, 7)
    df = spark.createDataFrame([(i, v, "e") for i, v in rows], "vec_id long, embedding array<float>, n string").repartition(6)
    got = whitening.whiten(df, 5).collect()
    kept = [(i, v) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    assert len(got) == 5 * len(kept)
    x = {str(v): [int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for _, v in kept}
    n, s, v = exact_covariance(list(x.values()))
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    of_id = {i: x[str(w)] for i, w in kept}
    sign = {}
    for r in got:
        c = np.array(of_id[r.vec_id])
        want = ((c - np.array(s) / n) @ axes[:, r.component - 1]) / np.sqrt(values[r.component - 1])
        if abs(want) > 1e-6:
            sign.setdefault(r.component, np.sign(want * r.whitened))
            assert abs(want * sign[r.component] - r.whitened) < 1e-9
        assert int(r.deviation) == sum((n * a - b) ** 2 for a, b in zip(of_id[r.vec_id], s)) and r.n == n
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-10 and r.identity_error < 1e-10


def test_whitening_of_few_equal_or_huge_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(make([]), 3).collect() == []
    same = whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])]), 3).collect()
    assert len(same) == 4 and all(r.whitened is None and r.explained == 0 and r.n == 1 and int(r.deviation) == 0 for r in same)
    two = whitening.whiten(make([(1, [0.0, 0.0, 5.0]), (2, [3.0, 4.0, 5.0])]), 3).collect()
    assert sorted(abs(r.whitened) for r in two if r.component == 1) == pytest.approx([1, 1]) and all(r.whitened is None for r in two if r.component > 1)
    huge = whitening.whiten(make([(i, [1e15 * i, float(i % 3), -3e14 * (i % 2)]) for i in range(9)]), 3).collect()
    x = [[int(np.floor(64e15 * i)), 64 * (i % 3), int(np.floor(-64 * 3e14 * (i % 2)))] for i in range(9)]
    s = [sum(c) for c in zip(*x)]
    assert {r.vec_id: int(r.deviation) for r in huge} == {i: sum((9 * a - b) ** 2 for a, b in zip(x[i], s)) for i in range(9)}
    wild = whitening.whiten(make([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 7.0])]), 2).collect()
    assert len(wild) == 6
    with pytest.raises(ValueError):
        whitening.whiten(make([(1, [1.0]), (2, [1.0, 2.0])]), 2)


def test_refinement_of_clustered_values():
    """Values closer than single, and than double, precision tells apart are separated by the sub-solves."""
    rng = np.random.default_rng(7)
    for values in ([5, 3, 3 + 1e-9, 3 - 1e-9, 1, 1 + 1e-12, 0.5], [2, 2, 2, 1, 1, 0, 0], [1e-8, 1, 1 + 1e-5, 1 + 2e-5, 4], list(np.geomspace(1, 1e-6, 30)) + [1.0 + 1e-7 * i for i in range(10)]):
        values = np.array(values, np.longdouble)
        q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0].astype(np.longdouble)
        for _ in range(3):  # orthogonal in extended precision
            q = q @ (3 * np.eye(len(q)) - q.T @ q) / 2
        a = (q * values) @ q.T
        found, x = whitening.eigen((a + a.T) / 2)
        want = np.sort(values)[::-1]
        assert np.abs(found - want).max() < 1e-15 * 8 * float(want[0])
        assert np.abs(x.T @ x - np.eye(len(x))).max() < 1e-14
        assert np.abs(a @ x - x * found).max() < 1e-15 * 16 * float(want[0])
        order = np.argsort(-values, kind="stable")
        for i in range(len(want)):
            gap = min([float(abs(want[i] - want[j])) for j in range(len(want)) if j != i])
            if gap > 1e-10:  # a single vector is defined to the precision of the gap
                assert abs(abs(float(q[:, order[i]] @ x[:, i])) - 1) < 1e-13 and np.abs(q[:, order[i]] * np.sign(q[:, order[i]] @ x[:, i]) - x[:, i]).max() < 1e-15 * 64 / min(gap, 1)


# clustering


def plain_clusters(rows, k, rounds, seed, dims):
    kept = [(i, [int(np.floor(64 * np.float64(c))) for c in v]) for i, v in rows if v and len(v) == dims and None not in v and np.isfinite(v).all()]
    seeds = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    c = [list(x) for _, x in seeds]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for j in range(len(c)):
            mine = [x for o, (_, x) in zip(own, kept) if o == j]
            if mine:
                c[j] = [sum(v) // len(mine) for v in zip(*mine)]
    return sorted((-1 if i is None else i, nearest(x)[1], nearest(x)[0]) for i, x in kept), c


@pytest.mark.parametrize("k,rounds,dims", [(5, 3, 6), (16, 8, 3), (70, 5, 2), (1, 2, 4), (500, 2, 3)])
def test_clusters_against_brute_force(spark, k, rounds, dims):
    rng = np.random.default_rng(k)
    centres = rng.normal(size=(9, dims))
    rows = [(i, (centres[i % 9] + 0.15 * rng.normal(size=dims)).tolist()) for i in range(300)]
    rows += [(i, [0.25 * (i % 3)] * dims) for i in range(300, 330)] + vectors_with_oddities(rng, 5, dims) + [(900, [1.0] * (dims + 1)), (901, [-0.0] * dims)]
    df = spark.createDataFrame([(i, v, 3, "a") for i, v in rows], "vec_id long, embedding array<double>, cluster int, x string").repartition(4)
    found = clustering.cluster(df, k, rounds, 1, 64, dims)
    want, centroids = plain_clusters(rows, k, rounds, 1, dims)
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in found.rows.collect()) == want
    assert found.centroids == centroids
    if 1 < k < 100:  # the bounds spare most distances
        assert sum(found.scanned[1:]) < 0.5 * rounds * found.scanned[0]


def test_clusters_of_nothing_and_far_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert clustering.clusters_with_inertia(make([]), dims=2).collect() == []
    got = clustering.clusters_with_inertia(make([(1, [1e300, 0.0]), (2, [0.0, 0.0]), (3, [1e300, 0.0]), (4, [-1e9, 2.0])]), k=2, rounds=2, dims=2).collect()
    assert sorted(r.vec_id for r in got) == [1, 2, 3, 4]


def test_bounds_stay_below_the_distances():
    """After many rounds of moving centroids no stored bound, once loosened, exceeds a true distance."""
    rng = np.random.default_rng(3)
    x = rng.integers(-200, 200, (400, 5))
    history = [rng.integers(-200, 200, (80, 5))]
    state = clustering.Bounds(history).first(x)[:5]
    for t in range(1, 9):
        history.append(history[-1] + rng.integers(-12, 13, (80, 5)))
        b = clustering.Bounds(history)
        own, d2, at, low, low_at, _ = b.again(x, *state, False)
        true = clustering.squares(x, history[-1])
        assert (own == true.argmin(1)).all()
        d = np.sqrt(true.astype(float))
        others = np.where(np.arange(80)[None, :] == own[:, None], np.inf, d)
        lowest = np.stack([others[:, b.group == g].min(1, initial=np.inf) for g in range(b.groups)], axis=1)
        loosened = low.astype(float) - b.group_moved[low_at, np.arange(b.groups)[None, :]]
        assert (loosened <= lowest + 1e-9).all()
        assert (np.sqrt(d2.astype(float)) + b.moved[at, own] >= d[np.arange(400), own] - 1e-9).all()
        state = own, d2, at, low, low_at


# multi-index hashing: norms, and the radius that the probes cover


def searched(spark, x, k=20):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    search = mih.Search(df, k)
    queries = search.rows.where("vec_id % 20 = 0")
    got: dict[int, list] = {}
    for r in search.nearest(queries).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(got[q]) & set(np.argsort(-s, kind="stable")[:k].tolist()))
    found = search.candidates(queries, search.reach, search.radius).collect()
    met, passed = sum(r.met for r in found), sum(len(r.ids) // 8 for r in found)
    pairs = len(got) * len(x)
    return hits / (k * len(got)), met / pairs, passed / pairs, search


@pytest.mark.parametrize("kind", ["equal", "outlier", "lognormal", "decades"])
def test_index_prunes_whatever_the_norms(spark, kind):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 64))
    if kind == "outlier":
        x[1234] *= 100
    elif kind == "lognormal":
        x *= np.exp(1.5 * rng.normal(size=(3000, 1)))
    elif kind == "decades":
        x *= 10.0 ** rng.integers(-30, 30, (3000, 1))
    recall, met, passed, _ = searched(spark, x)
    assert recall >= 0.9 and passed < 0.3 and met < 1.0, (recall, met, passed)


def test_every_code_within_the_radius_is_retrieved(spark):
    """Codes within COVERED bits come through the probes whatever the reach; none comes twice."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(60, 64))
    x = np.vstack([base[rng.integers(0, 60, 1500)] + rng.choice([0.05, 0.2, 0.5], (1500, 1)) * rng.normal(size=(1500, 64)), rng.normal(size=(1500, 64))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    search = mih.Search(df, 10)
    queries = search.rows.where("vec_id % 20 = 0")
    for reach in (search.reach, np.zeros(len(search.reach))):
        got = {}
        for r in search.candidates(queries, reach, search.radius).collect():
            got.setdefault(r.query_id, []).extend(np.frombuffer(r.ids, "<i8").tolist())
        assert all(len(set(v)) == len(v) for v in got.values())
        codes = {r.id: (r.part // mih.PARTS, np.frombuffer(r.code, "<u8")) for r in search.index.where(f"part % {mih.PARTS} = 0").collect()}
        ids, matrix = np.array(list(codes)), np.stack([c for _, c in codes.values()])
        span = np.array([j for j, _ in codes.values()])
        asked = {(r.id, r.part // mih.PARTS): np.frombuffer(r.code, "<u8") for r in search._entries(queries, reach).collect()}
        near = 0
        for (q, j), code in asked.items():
            inside = ids[(span == j) & (mih.hamming(matrix, code) <= mih.COVERED)]
            assert set(inside.tolist()) <= set(got.get(q, [])), (q, j)
            near += len(inside)
        assert near > 500
