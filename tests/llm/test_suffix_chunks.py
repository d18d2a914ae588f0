"""Crowded minimisers, dealt as pairs of chunks, against brute force."""

import random

import numpy as np

from ledgerloom.llm import suffix


def test_chunk_pairs_in_one_partition(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 2)
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefghijklmnop") for _ in range(100))

    def filler():
        return "".join(rng.choice("abcdefghijklmnop") for _ in range(120))

    texts = {i: filler() + passage + filler() for i in range(9)}
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        got = {r.doc_id: r.n_removed for r in suffix.digests(df, 80).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    for i, t in texts.items():
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 79):
            if any(t[p : p + 80] in o for j, o in texts.items() if j != i):
                gone[p : p + 80] = True
        assert got[i] == gone.sum()
