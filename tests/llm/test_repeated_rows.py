"""Repeated rows and copies without an id through the pipeline's first four stages."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_row_of_each_group_stays(spark, tmp_path):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(60):
        words = ["".join(rng.choice("abcdeth") for _ in range(rng.randint(2, 7))) for _ in range(90)]
        rows.append((i, " ".join(words if i % 4 else [x + "###" for x in words])))
        labels.append((i, int(i % 4 != 0), 0))
    texts = dict(rows)
    lone = " ".join("".join(rng.choice("abcdeth") for _ in range(rng.randint(2, 7))) for _ in range(90))
    rows += [(1, texts[1]), (1, texts[1]), (None, texts[2]), (None, lone), (None, lone), (3, texts[5])]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    left = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in docs.collect())
    # document 5 has a copy under the smaller id 3
    good = [i for i in range(60) if i % 4 and i != 5]
    assert left == sorted([(False, i, texts[i]) for i in good] + [(False, 3, texts[5]), (True, 0, lone)])
