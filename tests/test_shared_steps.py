"""Steps that many queries share: how often they shuffle or write their rows."""

import os

from pyspark.sql import functions as F

from ledgerloom.functions.lineage import cut, cut_in_order, shared_dir
from ledgerloom.operators import lines as L
from ledgerloom.operators import portfolio as P

SIGNED = "dossier long, pos int, source_file string, source_id string, fact_num string, lib_frss string, pct int, ttc decimal(18,2), date_fac date"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_duplicates_deal_lines_once(spark):
    rows = spark.createDataFrame([], SIGNED)
    text = plan(L.mark_duplicates(rows))
    assert text.count("Exchange") == 1 and "Join" not in text


def joins_that_carry(node, name):
    here = "Join" in node.nodeName() and f"{name}#" in node.output().toString()
    children = node.children()
    return here + sum(joins_that_carry(children.apply(i), name) for i in range(children.size()))


def test_identifiers_join_lines_once(spark):
    rows = spark.createDataFrame([(1, "A", "", "5", "x")], "dossier long, lib_frss string, ice_frs string, if_number string, payload string").repartition("payload")
    found = L.complete_identifiers(rows, ["dossier"])
    assert joins_that_carry(found._jdf.queryExecution().optimizedPlan(), "payload") == 1


def folder_bytes(path):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(path) for f in files)


def test_cut_rows_are_kept_compressed(spark):
    before = folder_bytes(shared_dir(spark))
    df = cut(spark.range(100_000).withColumn("text", F.lit("facture " * 20)))
    assert df.count() == 100_000 and df.schema["text"].dataType.simpleString() == "string"
    assert folder_bytes(shared_dir(spark)) - before < 2_000_000


def test_cut_in_order_keeps_order(spark):
    df = cut_in_order(spark.range(1000, 0, -1).orderBy("id")).withColumn("at", F.monotonically_increasing_id())
    assert [r.id for r in df.orderBy("at").collect()] == list(range(1, 1001))


def test_notebook_entries_of_one_rank_do_not_depend_on_order(spark):
    entries = [(1, "000000000000001", "7", "A", 5), (1, "000000000000001", "9", "C", 5), (1, "000000000000001", "8", "B", 5)]
    line = spark.createDataFrame([(1, "000000000000001", "", "X")], "client int, ice_frs string, if_number string, lib_frss string")
    for rows in (entries, entries[::-1]):
        notebook = spark.createDataFrame(rows, "client int, ice string, fiscal string, name string, entry int").coalesce(1)
        assert P.official_names(line, notebook).first().lib_frss == "C"
        assert tuple(P.merge_notebook(notebook, notebook.limit(0)).first()) == (1, "000000000000001", "9", "C")
