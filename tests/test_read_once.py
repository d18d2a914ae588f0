"""What a text or a table is read for several times is worked out once."""

import re

from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import textjobs as T

TEXT = "Poste 0\n10,00\n0,00\n10,00\nPoste 20\n100,00\n20,00\n120,00\nTOTAL HT : 110,00"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def texts(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "text string").repartition(1)


def test_detail_lines_are_split_once(spark):
    df = T.one_a_line(texts(spark, TEXT, "", None), [], T.detail_rows(F.col("text")), "label")
    assert len(re.findall(r"\bsplit\(", optimized(df))) == 1
    assert sorted(map(tuple, df.collect())) == [("Poste 0", 10.0, 0.0, 10.0), ("Poste 20", 100.0, 20.0, 120.0)]


def test_rate_rows_are_searched_once(spark):
    df = T.best_rows(texts(spark, "120,00 TTC 20,00% 20,00", "nothing"), [])
    assert len(re.findall(r"regexp_extract_all\(", optimized(df))) == 2  # both kinds of rows
    assert [tuple(r) for r in df.collect()] == [(20, 100.0, 20.0, 120.0)]


def test_amounts_of_totals_are_searched_once(spark):
    credit = texts(spark, "AVOIR N° A1\nNet à payer\n120,00 DH\n20,00 DH\n100,00 DH\nARRETEE", "AVOIR Net à payer 1,00", None)
    df = credit.select(T.credit_totals(F.col("text")).alias("t"))
    assert len(re.findall(r"regexp_extract_all\(", optimized(df))) == 1
    assert [r.t and tuple(r.t) for r in df.collect()] == [(-100.0, -20.0, -120.0), None, None]


def test_a_named_value_may_be_null(spark):
    assert spark.range(1).select(S.let(F.lit(None).cast("int"), lambda x: F.coalesce(x, F.lit(7)))).first()[0] == 7
