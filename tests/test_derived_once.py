"""Queries derive the lines that they read several times once, and replay whole buckets."""

import numpy as np
import pytest

from ledgerloom import plans
from ledgerloom.operators import bank as B
from ledgerloom.sources import driver_tables as D
from ledgerloom.streaming import store as ST

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["e04_supplier_subset", "e05_proposals", "h08_valid_proposals", "f29_proposal_detail", "c09_ventilate", "c10_reconcile"])
def test_lines_are_derived_once(spark, monkeypatch, name):
    calls, real = [], D.invoice_lines
    monkeypatch.setattr(D, "invoice_lines", lambda *a: calls.append(a) or real(*a))
    df = plans.QUERIES[name](spark, SF)
    assert len(calls) == 1 and "lineitem" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_groups_read_kept_lines(spark):
    df = plans.QUERIES["f07_normalise_groups"](spark, SF)
    assert "l_orderkey" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_a_declaration_is_made_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr("ledgerloom.plans.files.B.write_declaration", lambda rows, *a: made.append(rows._jdf.queryExecution().optimizedPlan().toString()))
    monkeypatch.setattr("ledgerloom.plans.files.B.read_declaration", lambda s, path: plans.QUERIES["a12_declaration_rows"](s, SF).selectExpr("*", "'f' as file_name"))
    plans.QUERIES["a12_declaration_files"](spark, SF)
    assert len(made) == 2 and all("l_orderkey" not in p for p in made)


def test_recounted_buckets_are_written_once(spark, monkeypatch):
    touched, real = [], ST.Ledgers.commit
    monkeypatch.setattr(ST.Ledgers, "commit", lambda self, query, epoch, buckets, new: (touched.extend(buckets if query == "import" else []), real(self, query, epoch, buckets, new))[1])
    plans.QUERIES["k04_recount"](spark, SF)
    assert touched and len(touched) == len(set(touched))


def test_small_sets_are_searched_as_large_ones(monkeypatch):
    r = np.random.default_rng(7)
    monkeypatch.setattr(B, "AT_ONCE", 100)
    for n in range(1, B.SMALL + 1):
        totals = r.integers(-400, 900, (60, n))
        targets = np.where(r.random(60) < 0.5, (totals * r.integers(0, 2, (60, n))).sum(1) + r.integers(-120, 120, 60), totals.sum(1))
        masks = B.small_subsets(totals, targets)
        for t, target, mask in zip(totals, targets, masks.tolist()):
            assert B.subset(t, int(target)) == ([j for j in range(n) if mask >> j & 1] or None)
