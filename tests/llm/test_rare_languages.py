"""Declared values under a 16,384th of the rows are languages like any others."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import langid

SCHEMA = "doc_id long, text string, lang string, host string"


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


def judged(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return {r.doc_id: r.language for r in langid.identify(docs, declared=F.col("lang"), host=F.col("host")).collect()}


@pytest.mark.parametrize("rarest", [8, 1])
def test_tables_judge_as_tasks_do(spark, monkeypatch, rarest):
    """Most languages, or all, in distributed tables: the same posteriors as with all in the tasks."""
    rng = random.Random(11)
    letters = {f"l{j:02}": "abcdefghijklmnopqrstuvwxyz"[j : j + 7] for j in range(14)}
    rows = []
    for i in range(240):
        lang = f"l{min(rng.randint(0, 13), rng.randint(0, 13)):02}"
        said = lang if rng.random() < 0.7 else rng.choice([*letters, None, None])
        rows.append((i, words(rng, letters[lang], rng.randint(1, 9)), said, rng.choice([f"{lang}.x", f"a.{lang}", "mixed.x", None])))
    rows += [(900, None, "l01", "mixed.x"), (901, "12 34", "tag", None), (902, "", None, None), (903, "ÿÿÿ ÿÿ", None, "mixed.x"), (904, "zzzz zzz", "l13", "new.y"), (905, *rows[5][1:]), (906, words(rng, "abcxyz", 300), None, None)]
    want = judged(spark, rows)
    monkeypatch.setattr(langid, "RAREST", rarest)
    got = judged(spark, rows)
    assert len(got) == len(rows)
    for i in want:
        assert math.isclose(got[i].probability, want[i].probability, rel_tol=1e-3, abs_tol=1e-6), i
        if abs(want[i].probability - 0.5) > 0.01:
            assert (got[i].lang, got[i].accepted) == (want[i].lang, want[i].accepted), i


def test_two_rows_of_forty_thousand(spark):
    rng = random.Random(12)
    usual = [words(rng, letters, 12) for letters in ("abcdef", "ghijkl") for _ in range(50)]
    rows = [(i, usual[i % 100], "one" if i % 100 < 50 else "two", None) for i in range(40_000)]
    rows += [(50_000 + j, words(rng, "qrstuv", 60), "few", None) for j in range(2)] + [(50_002, words(rng, "qrstuv", 60), None, None)]
    got = judged(spark, rows)
    assert all(got[i].lang == "few" and got[i].accepted for i in (50_000, 50_001, 50_002))
    assert all(got[i].lang == rows[i][2] and got[i].accepted for i in range(40_000))
