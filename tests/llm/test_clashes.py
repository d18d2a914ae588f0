"""Columns named like internal ones, repeated rows, and extreme or unequal vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import langid, metricjoin, mih, rules, simhash, suffix

NAMES = ["rid", "spans", "wanted", "wanted_by", "key", "of", "prior", "found", "stats", "doc", "k1", "k2", "k1_", "low", "high", "language", "h", "g", "label", "x"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with a column of each of those names, repeated rows and null ids, and labels."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(40):
        words = ["".join(rng.choice("abcdeth") for _ in range(rng.randint(2, 7))) for _ in range(90)]
        rows.append((i, " ".join(words if i % 4 else [w + "###" for w in words])))
        labels.append((i, int(i % 4 != 0), 0))
    rows += [rows[1], rows[1], (None, rows[2][1]), (50, None), (51, "")]
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    columns = ", ".join(f"`{n}` string" for n in NAMES)
    docs = spark.createDataFrame([(i, t, "en", "s.com", len(t or ""), *[f"mine {n}" for n in NAMES]) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {columns}")
    return docs, folder


def test_stages_keep_columns_of_any_name(spark, odd):
    docs, folder = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"mine {n}" for r in rows for n in NAMES)
    assert corpus_pipeline.packed(spark, docs, folder).count() >= docs.count()


def test_operators_ignore_columns_of_any_name(odd):
    docs, _ = odd
    n = docs.count()
    assert suffix.digests(docs, 80).count() == n and suffix.without_repeats(docs, 80).count() == n
    assert simhash.groups(docs).count() == n and simhash.near_duplicates(docs).count() == n - 1
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("label"))
    assert rules.quality(docs, labels, F.col("doc_id") % 3 == 1).count() == n
    with pytest.raises(ValueError):
        langid.identify(docs, into="Language")


def test_repeated_rows_leave_one(spark, odd):
    docs, folder = odd
    left = corpus_pipeline.near_duplicates(spark, docs, folder).collect()
    assert sorted(r.doc_id for r in left if r.text) == list(range(40))
    assert len([r for r in left if not r.text]) == 1


def test_extreme_magnitudes(spark):
    x = np.random.default_rng(1).normal(size=8)
    rows = [(0, x * 1e200), (1, x * 1e200 * (1 + 1e-9)), (2, x), (3, x * 1e-200), (4, -x), (5, x * 1e-310), (6, np.eye(8)[0] * 1e308)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in metricjoin.linked(df).collect()}
    assert [got[i].component_id for i in range(7)] == [0, 0, 0, 0, 4, 0, 6] and got[2].n_links == 4
    near = mih.nearest(df, F.col("vec_id") == 2, 3).orderBy("rank").collect()
    score = {i: float((v * x).sum()) for i, v in rows if i != 2}
    assert [r.vec_id for r in near] == sorted(score, key=lambda i: (-score[i], i))[:3] and all(np.isclose(r.score, score[r.vec_id], rtol=1e-12) for r in near)


def test_unequal_lengths_are_refused(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, [1.0])], "vec_id long, embedding array<double>")
    for call in (lambda: mih.nearest(df, F.col("vec_id") % 20 == 0), lambda: metricjoin.linked(df)):
        with pytest.raises(ValueError):
            call()
