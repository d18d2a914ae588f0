"""Every query against its DuckDB twin on the smallest tables."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry_point
from ledgerloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return str(round(float(v), 5)) if isinstance(v, (float, decimal.Decimal)) else str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    got = sorted(tuple(map(value, r)) for r in df.collect())
    if name not in plans.ORACLES:
        assert df.columns
        return
    cur = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    assert got == sorted(tuple(value(r[i]) for i in order) for r in cur.fetchall())


@pytest.fixture(scope="module")
def larger():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_twin_runs_on_larger_tables(larger, name):
    assert larger.execute(entry_point.oracle_sql()[name]).description


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
