"""What steps leave on the local disks, and how often they deal whole lines."""

import random
import re
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions.lineage import cut
from ledgerloom.operators import bank as B
from ledgerloom.operators import correction as C
from ledgerloom.operators import lines as L
from ledgerloom.plans import QUERIES
from ledgerloom.plans.textjobs import invoices
from ledgerloom.sources import driver_tables as D


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for i in range(files.size()) if (f := files.apply(i)).getName().startswith("shuffle_") and f.length() > 10_000}


def carrying(node, kind, name):
    here = kind in node.nodeName() and f"{name}#" in node.output().toString()
    children = node.children()
    return here + sum(carrying(children.apply(i), kind, name) for i in range(children.size()))


def test_cut_leaves_no_shuffle_files(spark):
    before = shuffled(spark)
    df = cut(spark.range(10_000).repartition("id"))
    assert df.count() == 10_000
    own = cut(df.groupBy((F.col("id") % 7).alias("k")).count())
    assert own.count() == 7 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert not shuffled(spark) - before


def test_lines_meet_orders_that_know_their_supplier(spark):
    assert carrying(D.invoice_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan(), "Join", "l_extendedprice") == 1


SCHEMA = "line long, dossier long, pos int, source_file string, source_id string, fact_num string, lib_frss string, ice_frs string, if_number string, pct int, ttc decimal(18,2), date_fac date, payload string"


def rows(spark, n=600):
    r = random.Random(5)
    ids = ["", "", "000000000000001", "000000000000002", "12"]
    made = [
        (i, r.choice([1, 2, None]), i, r.choice(["a.pdf", "b/c.pdf", "avoir.pdf", None]), r.choice(["", "s1", None]), r.choice(["F1", "F2", "AVOIR 3", "", None]), r.choice(["Un SARL", "Un", "Deux", "", None]), r.choice([*ids, None]), r.choice(["", " ", "41", "42", None]), r.choice([0, 20]), r.choice([1, 2]), None, "x")
        for i in range(n)
    ]
    return spark.createDataFrame([(*m[:10], Decimal(m[10]), *m[11:]) for m in made], SCHEMA)


def test_narrow_tables_mark_lines_as_whole_ones_do(spark):
    df = rows(spark)
    want = L.mark_duplicates(L.complete_identifiers(df, ["dossier"]))
    got = L.complete_and_mark(df, ["dossier"], "line")
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "payload" not in " ".join(re.findall(r"Exchange hashpartitioning.*", got._jdf.queryExecution().executedPlan().toString()))


def test_listed_credit_files_are_those_of_the_window(spark):
    df = rows(spark)
    assert sorted(map(str, L.credit_by_list(df).collect())) == sorted(map(str, L.credit(df).collect()))
    assert "Window" not in L.credit_by_list(df)._jdf.queryExecution().optimizedPlan().toString()


def test_issues_of_a_label_meet_in_one_row(spark):
    conf = "map<string, struct<level:string,reason:string>>"
    r = random.Random(3)
    made = [(r.choice([1, 2]), r.choice(["F1", "F2", ""]), r.choice(["A", ""]), i % 4, {k: (r.choice(["ok", "warn", "error"]), r.choice(["x", "y"])) for k in ("m_ht", "tva", "if")}, r.random() < 0.4, r.random() < 0.5, r.choice([[], [L.REVIEWED]])) for i in range(300)]
    df = spark.createDataFrame(made, f"dossier int, fact_num string, lib_frss string, pos int, conf {conf}, duplicate boolean, dismissed boolean, verified array<string>")
    want = set()
    for dossier, number, name, pos, found, duplicate, dismissed, verified in made:
        if L.REVIEWED not in verified:
            head = f"Facture {number}" if number else f"Ligne {pos}"
            label = f"{head} ({name})" if name else head
            want |= {(dossier, 0 if level == "error" else 1, label, k, level, why) for k, (level, why) in found.items() if level != "ok"}
            if duplicate and not dismissed:
                want.add((dossier, 1, label, "duplicate", "warn", "duplicate"))
    got = L.review_list(df)
    found = [tuple(x) for x in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert "Expand" not in (text := got._jdf.queryExecution().optimizedPlan().toString()) and "Union" not in text


def test_labels_are_cut_only_where_terms_begin(spark):
    r = random.Random(9)
    text = lambda n: "".join(r.choice("ABC") for _ in range(n))
    pay = [(d, f"T{i}", text(r.randint(0, 12))) for i in range(150) for d in [r.choice([1, 2])]]
    terms = sorted({(r.choice([1, 2]), text(r.randint(0, 4)), r.choice(["k", "l"])) for _ in range(40)})
    got = B.held_in_labels(spark.createDataFrame(pay, "dossier int, txn string, label string"), spark.createDataFrame(terms, "dossier int, term string, key string"), "dossier")
    want = sorted((d, t, term, k) for d, t, label in pay for scope, term, k in terms if scope == d and term and term in label)
    assert sorted((x.dossier, x.txn, x.term, x.key) for x in got.collect()) == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1


def test_a_batch_derives_its_lines_once(spark, monkeypatch):
    calls, real = [], D.invoice_lines
    monkeypatch.setattr(D, "invoice_lines", lambda *a: calls.append(a) or real(*a))
    df = QUERIES["f09_normalise_batch"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1 and "l_orderkey" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_decisions_deal_each_side_once(spark):
    lines = spark.createDataFrame([], "doc string, pos long, ht decimal(18,2), tva decimal(18,2), ttc decimal(18,2), pct int, fact_num string")
    docs = C.read_documents(spark.createDataFrame([], "doc string, text string"))
    assert C.decisions(lines, docs, ["doc"])._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1


def test_invoices_are_printed_after_they_are_dealt(spark):
    lines = D.invoice_lines(spark, "/root/testdata/sf0.001")
    plan = invoices(spark, "/root/testdata/sf0.001", lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [dossier" in plan
