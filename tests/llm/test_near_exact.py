"""The pipeline's near-duplicate stage against exact Jaccard similarities of 5-word shingles."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def edited(base, edits, tag):
    """``base`` with ``edits`` words far apart replaced."""
    w = base.split(" ")
    for k in range(edits):
        w[6 + k * 9] = f"{tag}{k}"
    return " ".join(w)


def test_links_by_exact_similarity(spark):
    rng = random.Random(3)
    rows = []
    for k in range(150):
        base = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(250))
        rows += [(2 * k, base), (2 * k + 1, edited(base, rng.randint(4, 9), "new"))]
    texts = dict(rows)
    similar = {}
    for k in range(150):
        a, b = shingles(texts[2 * k]), shingles(texts[2 * k + 1])
        similar[2 * k + 1] = len(a & b) / len(a | b) >= 0.8
    assert any(similar.values()) and not all(similar.values())
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert {i for i, s in similar.items() if not s} == {i for i in kept if i % 2}
