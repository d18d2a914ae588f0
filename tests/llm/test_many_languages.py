"""More declared languages than a full table holds: the rarest are learned too."""

import random

from pyspark.sql import functions as F

from ledgerloom.llm import langid


def test_rare_languages_are_learned(spark):
    rng = random.Random(6)
    alphabets = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 5)) for _ in range(80)]
    rows = []
    for k, letters in enumerate(alphabets):
        for j in range(4 + (k < 64)):
            text = " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(40))
            rows.append((len(rows), text, f"l{k:02}", f"h{j}.com"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    out = {r.doc_id: r.language for r in langid.identify(docs, declared=F.col("lang"), host=F.col("host")).collect()}
    assert all(out[i].lang == lang and out[i].accepted for i, _, lang, _ in rows)


def corpus(tags):
    """Four languages with rows of their own, and ``tags`` rows that declare a value no other row declares."""
    rng = random.Random(7)
    alphabets = ["abcde", "fghij", "klmno", "pqrst"]
    rows = []
    for i in range(400 + tags):
        letters = alphabets[i % 4]
        text = " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(6))
        rows.append((i, text, f"l{i % 4}" if i < 400 or i % 2 else f"tag-{i}", f"h{i % 50}.com" if i % 3 else None))
    return rows


def test_a_hundred_thousand_declared_values(spark):
    """Values too rare to be languages are neither collected nor learned; their rows are judged by the rest."""
    rows = corpus(200_000)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string").repartition(8)
    assert docs.select("lang").distinct().count() > 100_000
    sizes = []
    first = langid.learned
    langid.learned = lambda l, c, n, k: sizes.append((k, len(n))) or first(l, c, n, k)
    try:
        out = langid.identify(docs, declared=F.col("lang"), host=F.col("host"))
    finally:
        langid.learned = first
    assert sizes[0][0] == 4 and sizes[0][1] < 4 * 65_536
    wrong = out.where((F.col("language.lang") != F.concat(F.lit("l"), (F.col("doc_id") % 4).cast("string"))) | ~F.col("language.accepted")).count()
    assert wrong == 0


def test_priors_by_shuffle_are_those_by_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(300), "doc_id long, text string, lang string, host string").withColumn("apart1", F.lit("mine"))
    judged = lambda: {r.doc_id: (r.language.lang, round(r.language.probability, 9), r.apart1) for r in langid.identify(docs, declared=F.col("lang"), host=F.col("host")).collect()}
    whole = judged()
    monkeypatch.setattr(langid, "LOOKUP", 0)
    assert judged() == whole
    monkeypatch.setattr(langid, "BROADCAST_PRIORS", 0)
    assert judged() == whole and len(whole) == 700
