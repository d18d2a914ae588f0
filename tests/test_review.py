"""Literal cases of review rules, corrections by documents, and periods' steps."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import correction as C
from ledgerloom.operators import lines as L
from ledgerloom.operators import portfolio as P
from ledgerloom.operators import textjobs as T

LINE = (
    "fact_num string, designation string, ht decimal(18,2), tva decimal(18,2), ttc decimal(18,2), pct int, lib_frss string, ice_frs string, if_number string, date_fac date, date_paie date,"
    "engine string, warnings string, from_folder boolean, tva_calculated boolean, ice_inferred boolean, if_inferred boolean, sanitized boolean, reconstructed boolean, duplicate boolean, dismissed boolean, verified array<string>"
)
GIVEN = {
    "fact_num": "F1", "designation": "MATIERES CONSOMMABLES", "ht": 100, "tva": 20, "ttc": 120, "pct": 20, "lib_frss": "EAT MEAT SARL", "ice_frs": "002345678000012", "if_number": "12345678", "date_fac": date(2026, 1, 2), "date_paie": date(2026, 1, 9),
    "engine": "pdf", "warnings": "", "from_folder": False, "tva_calculated": False, "ice_inferred": False, "if_inferred": False, "sanitized": False, "reconstructed": False, "duplicate": False, "dismissed": False, "verified": [],
}


def judged(spark, client="", **changes):
    row = GIVEN | changes
    row |= {k: Decimal(str(row[k])) for k in ("ht", "tva", "ttc")}
    df = spark.createDataFrame([tuple(row.values())], LINE)
    r = L.confidence(df, F.lit(client)).first()
    return {k: (v.level, v.reason) for k, v in r.conf.items()}


POOR = {"engine": "ai", "warnings": "Scan difficile : relu"}
FREE = {"ht": 1058, "tva": 0, "ttc": 1058, "pct": 0}


@pytest.mark.parametrize(
    "changes, field, level",
    [
        ({}, "m_ht", "ok"), ({}, "ice_frs", "ok"), ({"ice_inferred": True}, "ice_frs", "warn"), ({"reconstructed": True}, "m_ttc", "warn"),
        ({"ht": 1000, "tva": 175, "ttc": 1175}, "taux", "warn"), ({"ttc": 150}, "m_ht", "error"), ({"ttc": 150}, "m_ttc", "error"), ({"ttc": 150}, "tva", "error"),
        ({"ht": 100000, "tva": 20000, "ttc": 119100}, "m_ht", "error"), (POOR, "m_ht", "warn"), ({"engine": "ai"}, "m_ht", "ok"), ({"warnings": "Scan difficile"}, "m_ht", "ok"),
        ({"ice_inferred": True, "verified": ["ice_frs"]}, "ice_frs", "ok"), ({"ttc": 150, "verified": ["m_ht"]}, "m_ht", "ok"), ({"ttc": 150, "verified": ["m_ht"]}, "m_ttc", "error"),
        (FREE | {"tva_calculated": True}, "tva", "ok"), (FREE | {"tva_calculated": True}, "taux", "ok"), (FREE, "designation", "ok"), (FREE | POOR, "tva", "warn"), (FREE | POOR, "m_ht", "ok"),
        ({"date_fac": None}, "date_fac", "warn"), ({"date_paie": None}, "date_paie", "warn"), ({"if_number": ""}, "if", "warn"), ({"fact_num": " "}, "fact_num", "error"), ({"duplicate": True}, "m_ttc", "warn"),
        ({"from_folder": True}, "lib_frss", "warn"), ({"lib_frss": "XZ1"}, "lib_frss", "warn"), ({"pct": 14}, "taux", "error"), ({"pct": 0}, "taux", "error"), ({"pct": 10}, "taux", "warn"),
        ({"ht": -100}, "m_ht", "error"), ({"ht": 0, "tva": 0, "ttc": 0}, "m_ttc", "error"), ({"ht": 0, "tva": 0, "ttc": 120}, "m_ttc", "error"), ({"ht": 20, "tva": 100, "ttc": 120}, "tva", "error"), ({"sanitized": True}, "m_ht", "warn"),
    ],
)
def test_confidence(spark, changes, field, level):
    assert judged(spark, **changes)[field][0] == level


def test_client_id_is_an_error(spark):
    assert judged(spark, client="003641228000030", ice_frs="003641228000030")["ice_frs"] == ("error", "client")


def test_verified_lines_and_duplicates(spark):
    rows = [(GIVEN | {"duplicate": d, "dismissed": x, "verified": v, "date_paie": None}) for d, x, v in ((True, False, []), (True, True, ["fact_num", "m_ttc"]), (True, False, [L.REVIEWED]), (False, False, []))]
    for r in rows:
        r |= {k: Decimal(str(r[k])) for k in ("ht", "tva", "ttc")}
    df = L.confidence(spark.createDataFrame([tuple(r.values()) for r in rows], LINE), F.lit(""))
    c = [F.col(x) for x in ("conf", "verified", "duplicate", "dismissed")]
    out = df.select(L.has_anomaly(*c).alias("a"), L.needs_review(c[0], c[2]).alias("r"), F.size(L.issues(*c)).alias("n")).collect()
    assert [r.a for r in out] == [True, False, False, False] and all(r.r for r in out) and [r.n for r in out] == [3, 0, 0, 0]


SCAN = """
Ventilation de la TVA
11) 1284,00TTC 20,00% 214,00 DH
13) 450,00TTC 10,00% 40,91 DH
Total HT 1479,09 DH
Total Taxes 254,91 DH
Total TTC 1734,00 DH
"""
TABLE = """
Taux Montant HT TVA
10,00 400,00 40,00
20,00 600,00 120,00
Total TTC 1160,00
"""
SHORT = "doc string, pos long, fact_num string, ht decimal(18,2), tva decimal(18,2), ttc decimal(18,2), pct int, credit boolean"


def ventilated(spark, lines, texts):
    rows = spark.createDataFrame([(d, p, n, *[Decimal(str(x)) for x in amounts], pct, False) for d, p, n, amounts, pct in lines], SHORT)
    return rows, C.read_documents(spark.createDataFrame(texts, "doc string, text string"))


def test_rate_rows_replace_lines(spark):
    lines = [("scan", 1, "F1", (1070, 214, 1284), 20), ("table", 2, "F2", (1000, 175, 1175), 20), ("two", 3, "A", (1070, 214, 1284), 20), ("two", 4, "B", (1, 1, 2), 20), ("none", 5, "F3", (1000, 175, 1175), 20)]
    rows, docs = ventilated(spark, lines, [("scan", SCAN), ("table", TABLE), ("two", SCAN), ("none", "nothing here")])
    got = {}
    for r in C.reconcile_documents(rows, docs, ["doc"]).orderBy("pos").collect():
        got.setdefault(r.doc, []).append((r.pct, float(r.ht), float(r.tva), float(r.ttc)))
    assert sorted(got["scan"]) == [(10, 409.09, 40.91, 450.0), (20, 1070.0, 214.0, 1284.0)]
    assert sorted(got["table"]) == [(10, 400.0, 40.0, 440.0), (20, 600.0, 120.0, 720.0)]
    assert len(got["two"]) == 2 and got["none"] == [(20, 1000.0, 175.0, 1175.0)]


def test_totals_taken_for_base(spark):
    lines = [("printed", 1, "F1", (150, 30, 180), 20), ("named", 2, "F2", (150, 30, 180), 20), ("ratio", 3, "F3", (120, 20, 140), 20), ("footer", 4, "F4", (240, 48, 288), 20), ("right", 5, "F5", (150, 30, 180), 20)]
    texts = [("printed", "Net 150,00 TTC"), ("named", "Total HT : 150,00\nTotal TTC : 180,00"), ("ratio", ""), ("footer", "Total HT : 200,00\nTotal TVA : 40,00\nTotal TTC : 240,00"), ("right", "")]
    rows, docs = ventilated(spark, lines, texts)
    got = {r.doc: (float(r.ht), float(r.tva), float(r.ttc)) for r in C.reconcile_documents(rows, docs, ["doc"]).collect()}
    assert got == {"printed": (125.0, 25.0, 150.0), "named": (150.0, 30.0, 180.0), "ratio": (100.0, 20.0, 120.0), "footer": (200.0, 40.0, 240.0), "right": (150.0, 30.0, 180.0)}


def test_weak_results(spark):
    schema = "doc string, lines array<struct<ht:decimal(18,2),ttc:decimal(18,2)>>"
    d = Decimal
    results = spark.createDataFrame([("a", []), ("b", [(d(0), d(0))]), ("c", [(d(5), d(0))]), ("e", None)], schema)
    again = spark.createDataFrame([("a", 1, [(d(1), d(1))]), ("a", 2, [(d(2), d(2))]), ("b", 1, []), ("c", 1, [(d(9), d(9))])], "doc string, attempt int, " + schema.split(", ", 1)[1])
    got = {r.doc: (r.reread, [float(x.ht) for x in r.lines or []]) for r in C.replace_weak(results, again, ["doc"]).collect()}
    assert got == {"a": (True, [2.0]), "b": (False, [0.0]), "c": (False, [5.0]), "e": (False, [])}


@pytest.mark.parametrize(
    "text, want",
    [
        ("FACTURE N° F100\n", ["F100"]), ("Transformé de : Facture N° F99\nFACTURE N° F100", ["F100"]), ("Objet : facture F99", []), ("annule  et\tremplace FACTURE F77", []), ("relatif à la FACTURE N° F55", ["F55"]), ("relatif à : FACTURE N° F55", []),
        ("AVOIR N° A12 suivant facture F12", ["A12"]), ("FACTURE\nNUMERO : FAC0111/2026", ["FAC0111/2026"]), ("référence" + " " * 70 + "FACTURE F31", []), ("référence" + " " * 72 + "FACTURE F31", ["F31"]),
    ],
)
def test_numbers_of_cited_documents(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.numbers(F.col("t"))).first()[0] == want


def test_steps_and_actions(spark):
    columns = "status string, lines long, bank long, anomalies long, bank_pending long, invoices_pending long, documents long"
    cases = {
        (None, 0, 0, 0, 0, 0, 0): ("create_period", None), ("exported", 3, 2, 0, 0, 0, 2): ("done", "done,done,pending,done,done"), ("draft", 0, 0, 0, 0, 0, 0): ("bank", "current,pending,done,pending,pending"),
        ("draft", 0, 0, 0, 1, 0, 0): ("extract_bank", "done,pending,current,pending,pending"), ("draft", 0, 4, 0, 0, 2, 2): ("analysis", "done,done,current,pending,pending"), ("draft", 0, 4, 0, 0, 0, 2): ("bank_match", "done,done,done,current,pending"),
        ("draft", 0, 4, 0, 0, 0, 0): ("review", "done,pending,done,current,pending"), ("draft", 5, 4, 2, 0, 0, 2): ("fix", "done,done,done,current,pending"), ("in_review", 5, 4, 0, 0, 0, 2): ("declare", "done,done,done,done,current"),
    }
    df = spark.createDataFrame(list(cases), columns)
    c = [F.col(x) for x in df.columns]
    got = df.select(P.next_action(*c).alias("action"), F.array_join(F.transform(P.pipeline_steps(*c), lambda s: s["state"]), ",").alias("steps")).collect()
    for r, (action, steps) in zip(got, cases.values()):
        assert r.action == action and (steps is None or r.steps == steps), action


def test_reconciliation_with_refunds(spark):
    d = Decimal
    orders = spark.createDataFrame([("1", "2026-01", "q1", "DELIVERED", d(100), d(10)), ("2", "2026-01", "q1", "CANCELLED", d(50), d(0)), ("3", "2026-01", "q2", "DELIVERED", d(70), d(7))], "order_id string, month string, half string, status string, amount decimal(18,2), fee decimal(18,2)")
    services = spark.createDataFrame([("1", "2026-01", "q1", d(10)), ("3", "2026-01", "q2", d(7)), ("9", "2026-01", "q2", d(5))], "order_id string, month string, half string, ht decimal(18,2)")
    refunds = spark.createDataFrame([("1", "2026-01", "q1", d(-2))], "order_id string, month string, half string, ht decimal(18,2)")
    summary = spark.createDataFrame([("2026-01", "q1", d("9.60"), d(100), d("-90.40")), ("2026-01", "q2", None, d(110), d("-95.60"))], "month string, half string, invoice_ttc decimal(18,2), collected decimal(18,2), payout decimal(18,2)")
    got = {r.half: r for r in P.reconcile(orders, services, refunds, summary).collect()}
    assert got["q1"].ok and got["q1"].gap == "refunds" and list(got["q1"].explanations) == ["refunds", "refunds-fees", "fees-unexplained"][:2]
    assert got["q2"].ok and got["q2"].gap == "missing-orders" and list(got["q2"].explanations) == ["missing-orders", "collected-missing-orders", "fees-explained"]
    assert got["all"].ok and got["all"].orders == 3


def test_positions_over_partitions(spark):
    df = spark.range(500).select(((F.col("id") * 7919) % 500).alias("k"), "id").repartition(7)
    rows = P.ranked(df, [F.desc("k")]).collect()
    assert sorted(r.position for r in rows) == list(range(1, 501)) and all(r.position == 500 - r.k for r in rows)
