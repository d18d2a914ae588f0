"""Literal cases of the rules, and order-dependent operators against plain Python."""

import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import amounts as A
from ledgerloom.functions import scalars as S
from ledgerloom.operators import bank as B
from ledgerloom.operators import lines as L
from ledgerloom.sources import bank_files as BF

AMOUNTS = "k int, ht decimal(18,2), tva decimal(18,2), ttc decimal(18,2), pct int, credit boolean"


def d(x):
    from decimal import Decimal

    return Decimal(str(x))


@pytest.mark.parametrize(
    "given, want",
    [
        ((-20, -1134, -5670, 20, True), (-4725, -945, -5670, 20)),
        ((-686.44, 969.44, 283, 20, False), None),
        ((150, 30, 180, 20, False), (150, 30, 180, 20)),
        ((20, 4, 24, 20, False), (20, 4, 24, 20)),
        ((100, 17.5, 117.5, 20, False), (100, 17.5, 117.5, 20)),
        ((2500, 0, 2500, 0, False), (2500, 0, 2500, 0)),
    ],
)
def test_repair(spark, given, want):
    ht, tva, ttc, pct, credit = given
    r = A.repair(spark.createDataFrame([(1, d(ht), d(tva), d(ttc), pct, credit)], AMOUNTS)).first()
    if want is None:
        assert min(r.ht, r.tva, r.ttc) >= 0 and float(r.ttc) == 969.44 and r.pct == 20
    else:
        assert (float(r.ht), float(r.tva), float(r.ttc), r.pct) == want


@pytest.mark.parametrize("ht, tva, ttc, pct, want", [(1905, 381, 0, 20, 2286), (-1905, -381, 0, 20, -2286), (100, 20, 119.5, 20, 119.5), (100, 0, 0, 20, 0), (800, 0, 0, 0, 800), (-686.44, 969.44, 0, 20, 0)])
def test_fill_total(spark, ht, tva, ttc, pct, want):
    df = spark.createDataFrame([(1, d(ht), d(tva), d(ttc), pct, False)], AMOUNTS)
    assert float(df.select(A.fill_total(F.col("ht"), F.col("tva"), F.col("ttc"), F.col("pct"))).first()[0]) == want


def one(spark, column, *values, schema="x string"):
    return spark.createDataFrame([tuple(values)], schema).select(column).first()[0]


def test_scalars(spark):
    x = F.col("x")
    assert one(spark, S.beneficiary(x), "Virement en faveur de MPro , BMCE") == "MPRO"
    assert one(spark, S.supplier_key(x), "Eat Meat S.A.R.L") == one(spark, S.supplier_key(x), "EATMEAT SARL") == "EATMEAT"
    assert one(spark, S.supplier_hint(x), "Mose food/a.pdf") == one(spark, S.supplier_hint(x), "factures/Mose food/a.pdf") == "Mose Food"
    assert one(spark, S.supplier_hint(x), "2026-06/a.pdf") is None
    assert tuple(one(spark, S.split_tag(x), "facture__RC__src-2.pdf")) == ("facture.pdf", "src-2") == tuple(one(spark, S.split_tag(S.add_tag(F.lit("facture.pdf"), F.lit("src-2"))), ""))
    assert tuple(one(spark, S.split_tag(x), "facture.pdf__RC__src-1")) == ("facture.pdf", "src-1")
    assert one(spark, S.money_document(x), "10 368,00") == 10368.0 and one(spark, S.money_bank(x), "1.234,56 DH") == 1234.56
    assert one(spark, S.date_document(x), "31/02/2024 puis 2024-03-01") == date(2024, 3, 1)


def test_subset_is_lowest_mask():
    rng = random.Random(4)
    for _ in range(60):
        totals = np.array([rng.randint(-20_000, 90_000) for _ in range(rng.randint(1, 11))], np.int64)
        target = rng.randint(1000, 200_000)
        want = next((list(range(len(totals))) for _ in [0] if abs(int(totals.sum()) - target) <= 100), None)
        if want is None:
            for mask in range(1, 1 << len(totals)):
                chosen = [i for i in range(len(totals)) if mask >> i & 1]
                if abs(int(totals[chosen].sum()) - target) <= 100:
                    want = chosen
                    break
        assert B.subset(totals, target) == want
    assert B.subset(np.arange(1, 26) * 1000, 1000) is None


LINE = "dossier long, client long, pos int, fact_num string, lib_frss string, source_file string, designation string, ttc decimal(18,2), date_paie date"


def statement(spark, lines, amount, label, aliases=None):
    rows = [(1, 1, i, n, s, "f.pdf", "MATIERES CONSOMMABLES", d(t), None) for i, (n, s, t) in enumerate(lines)]
    pay = spark.createDataFrame([(1, 1, "t1", date(2026, 6, 1), label, d(abs(amount)))], "dossier long, client long, txn string, date date, label string, abs_amount decimal(18,2)")
    table = spark.createDataFrame(aliases, "client long, token string, key string") if aliases else None
    return B.apply_statements(pay, spark.createDataFrame(rows, LINE), table).first()


def test_statements(spark):
    three = [("A1", "MODE FOOD", 1284), ("A2", "MODE FOOD", 450), ("A3", "MODE FOOD", 1740)]
    r = statement(spark, three, 3474, "VIR EN FAVEUR DE MPro , BMCE")
    assert r.outcome == "pending" and r.suppliers == ["MODEFOOD"]
    r = statement(spark, three, 3474, "VIR EN FAVEUR DE MPRO , BMCE", [(1, "MPRO", "MODEFOOD")])
    assert r.outcome == "matched" and r.positions == [0, 1, 2]
    r = statement(spark, [("B1", "ALPHA", 3474), ("B2", "BRAVO", 3474)], 3474, "VIREMENT")
    assert r.outcome == "pending" and sorted(r.suppliers) == ["ALPHA", "BRAVO"]
    r = statement(spark, [("C1", "Eat Meat SARL", 1000), ("C2", "EATMEAT", 2000), ("C3", "Eatmeat", 500)], 3000, "PRLV EATMEAT")
    assert r.outcome == "matched" and r.positions == [0, 1]
    assert statement(spark, three, 99, "VIR X").outcome == "unmatched"


def test_duplicates_against_python(spark):
    rng = random.Random(9)
    rows = [(1, i, rng.choice(["a/f1.pdf", "f2.pdf"]), rng.choice(["", "src-1", "src-2"]), f"N{rng.randint(1, 6)}", rng.choice(["X SARL", "Y"]), rng.choice([10, 20]), d(rng.choice([10, 12])), date(2026, 1, rng.randint(1, 3))) for i in range(80)]
    got = {r.pos: r.duplicate for r in L.mark_duplicates(spark.createDataFrame(rows, "dossier long, pos int, source_file string, source_id string, fact_num string, lib_frss string, pct int, ttc decimal(18,2), date_fac date")).collect()}
    seen = set()
    for _, pos, file, sid, num, name, pct, ttc, day in rows:
        tail = (pct, ttc)
        sigs = {("s", name.split()[0], num, *tail), ("f", file, num, *tail), ("d", file, day, *tail)} | ({("i", sid, num, *tail)} if sid else set())
        assert got[pos] == bool(sigs & seen)
        seen |= sigs


def test_statement_file(spark, tmp_path):
    (tmp_path / "r.csv").write_text("﻿Relevé;\nDate;Libellé;Débit;Crédit\n01/06/2026;Solde initial;;10\n02/06/26;Achat;1 234,50;\n03/06/2026;Commission;12,00;\n04/06/2026;Client;;99,10\n;vide;5;\n", encoding="utf-8")
    rows = [(r.date, r.label, r.amount, r.kind) for r in BF.transactions(spark, str(tmp_path)).orderBy("offset").collect()]
    assert rows == [("2026-06-02", "Achat", -1234.5, "payment"), ("2026-06-03", "Commission", -12.0, "fee"), ("2026-06-04", "Client", 99.1, "credit")]


def test_synthetic_ledger(spark):
    df = BF.synthetic_lines(spark, 200, 10)
    assert df.count() == 200 and df.where("ice_frs = ''").count() == 20
