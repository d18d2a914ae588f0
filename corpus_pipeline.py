"""Preparation of a training corpus: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last keep the columns of documents. :func:`run` chains them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import langid, packing, rules, simhash, suffix
from ledgerloom.llm.common import fresh, written

#: Jaccard similarity from which 5-word shingle sets are near copies, decided on the sets themselves.
NEAR = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without letters or in none of the languages go.

    Null and empty texts have no letters. Repeated rows and null ids are judged
    like any others; an empty table gives no rows; columns of any name stay.
    """
    (found,) = fresh(docs, "found")
    return langid.identify(docs, declared=F.col("lang"), host=F.col("source"), into=found).where(F.col(f"{found}.accepted")).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules learned from ``labels`` find good.

    Null and empty texts are scored by their zero statistics. Repeated rows are
    scored alike, those with a null id too; without usable labels all stay; an
    empty table gives no rows; columns of any name stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    (stats,) = fresh(docs, "stats")
    model = rules.learn(docs, labels)
    return docs.withColumn(stats, rules.statistics_of("text")).where(model.score(F.col(stats)) >= 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest id, rows without an id last.

    Rows count by themselves: of repeated rows, and of copies without an id, one
    stays. Null and empty texts are copies of each other; an empty table gives
    no rows; columns of any name stay.
    """
    return simhash.one_of_each(docs, NEAR, ngram=5)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that occur again; ``n_chars`` follows the text.

    Every row stays, if need be with an empty text; a null text stays null;
    repeated rows are places of their own; an empty table gives no rows; columns
    of any name stay.
    """
    return suffix.without_repeats(docs, 200).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest in sequences of 1024 tokens: one row per piece.

    A null or empty text is the end id alone; repeated rows and null ids are
    packed as documents of their own; an empty table gives no rows; other
    columns are left out.
    """
    return packing.pack(docs, end_id=0, window=1024)


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("packing", packed)]

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each but the last is written and read again, so that none is computed twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
