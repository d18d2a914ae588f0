"""The pipeline's stages on a small corpus, each against a plain version of its decision."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from ledgerloom.llm import tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, alphabet, n):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(160):
        lang = "en" if i % 2 else "fr"
        w = words(rng, "abcdeth" if i % 2 else "uvxyzeo", rng.randint(40, 160))
        good = i % 5 != 0
        rows.append([i, " ".join(w if good else [x + "###" for x in w]), lang, f"s{i % 3}"])
        labels.append((i, int(good), 0))
    base = rows[3][1].split(" ")
    rows.append([200, " ".join(base), "en", "s0"])  # exact copy of 3
    rows.append([201, " ".join([*base[:7], "changed", *base[8:]]), "en", "s1"])  # near copy of 3
    passage = " ".join(words(rng, "abcdeth", 70))
    for k in (210, 211):
        rows.append([k, " ".join(words(rng, "abcdeth", 90)) + " " + passage + " " + " ".join(words(rng, "abcdeth", 90)), "en", "s2"])
    rows += [[220, None, "en", "s0"], [221, "", "fr", "s1"], [222, "123 456", None, None]]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, {r[0]: r[1] for r in rows}, {i for i, q, _ in labels if q == 0}, passage


def test_stages(spark, corpus, tmp_path):
    folder, texts, bad, passage = corpus
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r.doc_id: r.text for r in docs.collect()})
    language, quality, near, strings = kept
    assert set(texts) - set(language) == {220, 221, 222}
    assert set(language) - set(quality) == bad
    assert set(quality) - set(near) == {200, 201}
    assert set(strings) == set(near)
    for i, t in near.items():
        raw, gone = t.encode(), np.zeros(len(t.encode()), bool)
        for p in range(len(raw) - 199):
            if any(raw[p : p + 200] in o.encode() for j, o in near.items() if j != i):
                gone[p : p + 200] = True
        assert strings[i] == bytes(b for b, g in zip(raw, gone) if not g).decode()
    assert passage not in strings[210] and passage not in strings[211]
    rows = corpus_pipeline.packed(spark, docs, folder).collect()
    assert {r.doc_id for r in rows} == set(strings)
    for r in rows:
        ids = np.append(tokens.encode(tokens.vocabulary_path(), strings[r.doc_id]), [0]).astype("<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.offset + r.length <= 1024


def test_run_and_empty(spark, corpus, tmp_path):
    assert corpus_pipeline.run(spark, corpus[0]).count() > 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
