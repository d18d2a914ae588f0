"""Repeated rows among the queries of the nearest-neighbour search."""

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import mih


def test_repeated_query_rows_count_once(spark):
    x = np.random.default_rng(4).normal(size=(200, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + rows[:40], "vec_id long, embedding array<double>")
    found: dict[int, list] = {}
    for r in mih.nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert set(found) == set(range(0, 200, 20))
    assert all(len(ids) == len(set(ids)) == 20 for ids in found.values())
