"""Queries of periods, portfolio, import jobs, delivery and suppliers, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import amounts as A
from ledgerloom.functions import scalars as S
from ledgerloom.operators import portfolio as P
from ledgerloom.plans.scalars import key_sql
from ledgerloom.sources import driver_tables as D

AS_OF = "2024-02-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def periods(spark, sf_dir):
    """Periods of clients out of orders: status by dossier, last change at the last order."""
    o = D.table(spark, sf_dir, "orders")
    client = F.floor(F.col("o_custkey") / 300)
    p = o.select(client.alias("client"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), "o_orderdate").groupBy("client", "year", "month").agg(F.max("o_orderdate").alias("updated_at"))
    p = p.withColumn("dossier", F.col("client") * 1000 + (F.col("year") - 1990) * 12 + F.col("month"))
    return p.withColumn("status", F.when(F.col("dossier") % 3 == 0, "exported").when(F.col("dossier") % 3 == 1, "in_review").otherwise("draft"))


PERIODS = "periods AS (SELECT *, CASE dossier % 3 WHEN 0 THEN 'exported' WHEN 1 THEN 'in_review' ELSE 'draft' END AS status FROM (SELECT o_custkey // 300 AS client, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, max(o_orderdate) AS updated_at, (o_custkey // 300) * 1000 + (year(o_orderdate) - 1990) * 12 + month(o_orderdate) AS dossier FROM orders GROUP BY ALL))"


def summary(spark, sf_dir):
    """Counts of lines, incoherent lines, bank movements and documents of each dossier (F15); documents without a source id count as not read yet."""
    lines = D.invoice_lines(spark, sf_dir)
    bad = ~A.coherent(F.col("ht"), F.col("tva"), F.col("ttc"), F.col("pct"))
    # one row per document first, so that documents are counted without expansion
    docs = lines.groupBy("dossier", "source_file").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.max(F.col("source_id") == "").alias("unread"))
    a = docs.groupBy("dossier").agg(F.sum("n").alias("lines"), F.sum("bad").alias("anomalies"), F.count("*").alias("documents"), F.count_if("unread").alias("invoices_pending"))
    b = D.payments(spark, sf_dir).groupBy("dossier").agg(F.count("*").alias("bank"))
    out = a.join(b, "dossier", "full_outer").select("dossier", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("lines", "anomalies", "bank", "documents", "invoices_pending")])
    return out.withColumn("bank_pending", F.when(F.col("dossier") % 4 == 0, F.lit(1)).otherwise(0).cast("long"))


def f15_ledger_summary(spark, sf_dir):
    """Counts of each ledger."""
    return summary(spark, sf_dir)


def f16_cockpit(spark, sf_dir):
    """Cockpit row of each period, zeros where it has no ledger."""
    lines = D.invoice_lines(spark, sf_dir)
    a = lines.groupBy("dossier").agg(F.count("*").alias("lines"), F.count_if(F.col("date_paie").isNull()).alias("undated"), F.array_join(F.slice(F.array_sort(F.collect_set("fact_num")), 1, 3), ",").alias("refs"))
    return periods(spark, sf_dir).select("dossier", "status").join(a, "dossier", "left").select("dossier", "status", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("undated", F.lit(0)).alias("undated"), F.coalesce("refs", F.lit("")).alias("refs"))


def g05_active_period(spark, sf_dir):
    """Active period of each client."""
    return P.active_period(periods(spark, sf_dir)).select("client", "dossier", "status")


def f19_client_stats(spark, sf_dir):
    """Figures of each client's periods."""
    return P.client_stats(periods(spark, sf_dir)).withColumn("last", F.date_format("last", "yyyy-MM-dd"))


def f20_year_grid(spark, sf_dir):
    """Months of each client and year."""
    return P.year_grid(periods(spark, sf_dir))


def f30_periods_by_year(spark, sf_dir):
    """Periods of each client and year, newest month first."""
    return periods(spark, sf_dir).groupBy("client", "year").agg(F.array_join(F.transform(F.sort_array(F.collect_list("month"), asc=False), lambda m: m.cast("string")), ",").alias("months"))


def _portfolio(spark, sf_dir):
    return P.portfolio(periods(spark, sf_dir), summary(spark, sf_dir), P.roll_up_jobs(D.import_jobs(spark, sf_dir)).select("dossier", "active"), as_of())


COLUMNS = ["client", "dossier", "status", "lines", "bank", "anomalies", "open", "progress", "days", "priority", "action", "late", "done", "validate", "importing"]


def e16_portfolio(spark, sf_dir):
    """One row per client."""
    return _portfolio(spark, sf_dir).select(*COLUMNS)


def f21_kpis(spark, sf_dir):
    """Figures of the whole portfolio."""
    return P.kpis(_portfolio(spark, sf_dir))


def h01_portfolio_order(spark, sf_dir):
    """Position of each client in the portfolio."""
    rows = _portfolio(spark, sf_dir).select("client", "anomalies", P.priority_rank(F.col("priority")).alias("rank"))
    return P.ranked(rows, [F.col("rank"), F.desc("anomalies"), F.col("client")]).select("client", "position")


def h02_portfolio_filters(spark, sf_dir):
    """Clients in each filter of the portfolio."""
    f = F.filter(F.array(F.lit("all"), F.when(F.col("priority").isin("critical", "high"), "priority"), F.when(F.col("late"), "late"), F.when(F.col("validate") & ~F.col("done"), "validate"), F.when(F.col("done"), "done")), lambda x: x.isNotNull())
    return _portfolio(spark, sf_dir).select("client", F.explode(f).alias("filter"))


def j06_progress(spark, sf_dir):
    """Progress of every period."""
    p = periods(spark, sf_dir).join(summary(spark, sf_dir), "dossier", "left").fillna(0)
    return p.select("dossier", P.progress(F.col("status"), F.col("lines"), F.col("bank"), F.col("anomalies")).alias("progress"))


def _steps():
    return F.array_join(F.transform("steps", lambda x: F.concat_ws(":", x["step"], x["state"])), ",")


def j08_next_action(spark, sf_dir):
    """Next action in every period."""
    return P.cockpit(periods(spark, sf_dir), summary(spark, sf_dir), as_of()).select("dossier", "action")


def j09_cockpit(spark, sf_dir):
    """Cockpit of every period with the states of its five steps."""
    return P.cockpit(periods(spark, sf_dir), summary(spark, sf_dir), as_of()).select("dossier", "operations", "progress", "days", "priority", "late", "action", _steps().alias("steps"))


def j10_jobs(spark, sf_dir):
    """Jobs with progress, active and stale marks."""
    return P.active_jobs(D.import_jobs(spark, sf_dir), as_of()).select("job", "progress", "stale", "active")


def f22_roll_up_jobs(spark, sf_dir):
    """Active jobs of each dossier in one row."""
    return P.roll_up_jobs(D.import_jobs(spark, sf_dir))


def f23_import_summary(spark, sf_dir):
    """Outcome of each dossier's imports."""
    return P.import_summary(D.import_jobs(spark, sf_dir))


def k02_sweep(spark, sf_dir):
    """Next state of every job."""
    return P.sweep(D.import_jobs(spark, sf_dir), as_of()).select("job", "status", "next")


def h04_activity(spark, sf_dir):
    """The 20 newest entries of each dossier's activity."""
    e = D.table(spark, sf_dir, "events").select(F.col("user_id").alias("dossier"), "event_id", "ts", "event_type")
    return P.newest(e, "dossier", [F.desc("ts"), F.desc("event_id")], 20).select("dossier", "event_id", "event_type", "rank")


def h05_queue(spark, sf_dir):
    """The ten oldest queued jobs."""
    return D.import_jobs(spark, sf_dir).where("status = 'queued'").orderBy("created_at", "job").limit(10).select("job", "dossier")


def h07_jobs(spark, sf_dir):
    """The ten newest active jobs of each dossier."""
    return P.newest(D.import_jobs(spark, sf_dir).where(F.col("status").isin(P.ACTIVE)), "dossier", [F.desc("created_at"), F.desc("job")], 10).select("dossier", "job", "rank")


def f10_order_totals(spark, sf_dir):
    """Orders of each half-month."""
    return _double(P.order_totals(D.platform_orders(spark, sf_dir)), "collected", "fees", "fees_ttc", "payout")


def f11_invoice_totals(spark, sf_dir):
    """Billed services of each half-month."""
    return _double(P.invoice_totals(D.platform_services(spark, sf_dir), D.platform_refunds(spark, sf_dir), D.platform_summary(spark, sf_dir)), "services_ht", "refunds_ht", "collected", "billed", "billed_ttc", "payout")


def e13_match_orders(spark, sf_dir):
    """Orders against billed services."""
    return P.match_orders(D.platform_orders(spark, sf_dir), D.platform_services(spark, sf_dir)).select("month", "half", "order_id", "kind")


def f12_reconcile(spark, sf_dir):
    """Half-months and months reconciled."""
    out = P.reconcile(D.platform_orders(spark, sf_dir), D.platform_services(spark, sf_dir), D.platform_refunds(spark, sf_dir), D.platform_summary(spark, sf_dir))
    return _double(out, "collected", "fees", "refunds_ht", "delta", "delta_after", "collected_delta", "payout_delta").withColumn("explanations", F.array_join("explanations", ","))


def f18_suppliers(spark, sf_dir):
    """Suppliers of each client, overall, by year and by month, with their newest invoices."""
    tree = P.supplier_tree(D.invoice_lines(spark, sf_dir))
    listed = F.array_join(F.transform("listed", lambda x: F.concat_ws(":", x["year"].cast("string"), x["month"].cast("string"), x["fact_num"], x["ttc"].cast("string"))), ";")
    return _double(tree.withColumn("listed", listed), "ttc")


def f18_supplier_invoices(spark, sf_dir):
    """All invoices of each supplier."""
    return _double(P.supplier_invoices(D.invoice_lines(spark, sf_dir)), "ttc")


def notebook(spark, sf_dir):
    """A supplier notebook out of the lines: some suppliers by company id, others by fiscal id."""
    s = D.invoice_lines(spark, sf_dir).where("ice_frs <> '' and if_number <> ''").select("client", "ice_frs", "if_number").distinct()
    k = F.col("if_number").try_cast("long")
    return s.where(k % 3 != 0).select("client", F.when(k % 3 == 1, F.col("ice_frs")).otherwise("").alias("ice"), F.col("if_number").alias("fiscal"), F.concat(F.lit("OFFICIEL "), "if_number").alias("name"), F.col("ice_frs").try_cast("long").alias("entry"))


NOTEBOOK = "nb AS (SELECT DISTINCT client, CASE WHEN CAST(if_number AS BIGINT) % 3 = 1 THEN ice_frs ELSE '' END AS ice, if_number AS fiscal, 'OFFICIEL ' || if_number AS name, CAST(ice_frs AS BIGINT) AS entry FROM (SELECT * FROM lines WHERE ice_frs <> '' AND if_number <> '') WHERE CAST(if_number AS BIGINT) % 3 <> 0)"


def e07_official_names(spark, sf_dir):
    """Names from the notebook."""
    return P.official_names(D.invoice_lines(spark, sf_dir), notebook(spark, sf_dir)).select("dossier", "pos", "lib_frss", "changed")


def e20_merge_notebook(spark, sf_dir):
    """Notebook after an upsert."""
    n = notebook(spark, sf_dir)
    return P.merge_notebook(n.where("entry % 2 = 0"), n.where("entry % 2 = 1").withColumn("name", F.concat("name", F.lit(" SARL"))))


def h03_supplier_search(spark, sf_dir):
    """Suppliers of each client whose name or ids hold a term, by total."""
    lines = D.invoice_lines(spark, sf_dir)
    hit = F.lower(F.concat_ws(" ", "lib_frss", "ice_frs", "if_number")).contains("0003")
    return lines.where(hit).groupBy("client", S.supplier_key(F.col("lib_frss")).alias("key")).agg(F.sum("ttc").cast("double").alias("ttc"))


def e19_visible(spark, sf_dir):
    """Periods a member may see: those of the clients of its firm (region)."""
    nation, customer = D.table(spark, sf_dir, "nation"), D.table(spark, sf_dir, "customer")
    mine = customer.join(F.broadcast(nation.where("n_regionkey = 1")), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    orders = D.table(spark, sf_dir, "orders")
    return orders.join(mine, F.col("o_custkey") == F.col("c_custkey"), "left_semi").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.count("*").alias("orders"))


def e22_firms(spark, sf_dir):
    """Firms (nations) with their active owner: the oldest customer in credit."""
    c = D.table(spark, sf_dir, "customer").where("c_acctbal > 0").groupBy("c_nationkey").agg(F.min_by("c_name", "c_custkey").alias("owner"))
    return D.table(spark, sf_dir, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", "owner")


def e21_clients(spark, sf_dir):
    """Clients with their periods nested, newest first."""
    return periods(spark, sf_dir).groupBy("client").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("year", "month", "status")), asc=False), lambda p: F.concat_ws(":", p["year"].cast("string"), p["month"].cast("string"), p["status"])), " ").alias("periods"))


def _double(df, *cols):
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


QUERIES = {f.__name__: f for f in (
    f15_ledger_summary, f16_cockpit, g05_active_period, f19_client_stats, f20_year_grid, f30_periods_by_year, e16_portfolio, f21_kpis, h01_portfolio_order, h02_portfolio_filters, j06_progress, j08_next_action, j09_cockpit, j10_jobs, f22_roll_up_jobs, f23_import_summary, k02_sweep,
    h04_activity, h05_queue, h07_jobs, f10_order_totals, f11_invoice_totals, e13_match_orders, f12_reconcile, f18_suppliers, f18_supplier_invoices, e07_official_names, e20_merge_notebook, h03_supplier_search, e19_visible, e22_firms, e21_clients,
)}


def _near(a, b, lo, hi):
    return f"(abs({a}) >= abs({b}) * {lo} AND abs({a}) <= abs({b}) * {hi})"


COHERENT = f"(NOT (abs(ht) < 0.01 AND abs(ttc) < 0.01) AND abs(abs(ht) + abs(tva) - abs(ttc)) <= greatest(0.05, abs(ttc) * 0.01) AND CASE WHEN abs(ht) <= 0.01 THEN true WHEN pct = 0 THEN abs(tva) <= 0.05 AND abs(abs(ht) - abs(ttc)) <= 0.05 WHEN pct = 10 THEN {_near('tva', 'ht', 0.075, 0.125)} ELSE {_near('tva', 'ht', 0.175, 0.225)} END)"
SUMMARY = f"""{D.LINES}, {D.PAYMENTS}, la AS (SELECT dossier, count(*) AS lines, count(*) FILTER (NOT {COHERENT}) AS anomalies, count(DISTINCT source_file) AS documents, count(DISTINCT source_file) FILTER (source_id = '') AS invoices_pending FROM lines GROUP BY dossier), lb AS (SELECT dossier, count(*) AS bank FROM payments GROUP BY dossier),
summary AS (SELECT dossier, coalesce(lines, 0) AS lines, coalesce(anomalies, 0) AS anomalies, coalesce(bank, 0) AS bank, coalesce(documents, 0) AS documents, coalesce(invoices_pending, 0) AS invoices_pending, CAST(CASE WHEN dossier % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS bank_pending FROM la FULL JOIN lb USING (dossier))"""
#: Counts of a joined summary, zero where there is none.
COUNTED = ", ".join(f"coalesce({c}, 0) AS {c}" for c in P.COUNTS)
ACTION = "CASE WHEN status = 'exported' THEN 'done' WHEN bank = 0 AND bank_pending = 0 THEN 'bank' WHEN bank = 0 AND lines = 0 THEN 'extract_bank' WHEN lines = 0 AND bank_pending + invoices_pending > 0 THEN 'analysis' WHEN lines = 0 AND bank > 0 AND documents > 0 THEN 'bank_match' WHEN lines = 0 AND (bank > 0 OR documents > 0) THEN 'review' WHEN lines = 0 THEN 'purchases' WHEN anomalies > 0 THEN 'fix' ELSE 'declare' END"
PRIORITY = "CASE WHEN status = 'exported' THEN 'done' WHEN days <= 7 OR anomalies >= 5 THEN 'critical' WHEN days <= 14 OR anomalies > 0 OR status = 'in_review' THEN 'high' WHEN progress > 0 THEN 'normal' ELSE 'low' END"
DAYS = f"CAST(ceil((epoch(make_date(year, month, 1) + INTERVAL 1 MONTH + INTERVAL 19 DAY + INTERVAL 86399 SECOND) - epoch(TIMESTAMP '{AS_OF}')) / 86400.0) AS INTEGER)"
ROLL = f"{D.JOBS}, rolled AS (SELECT dossier, count(*) AS active, sum(total) AS total, sum(processed) AS processed, arg_max(status, CASE status WHEN 'processing' THEN 3 WHEN 'queued' THEN 2 ELSE 1 END) AS status, arg_max(job, (created_at, job)) AS newest FROM jobs WHERE status IN ('uploading', 'queued', 'processing') GROUP BY dossier)"
PROGRESS = "CASE WHEN status = 'exported' THEN 100 ELSE least(99, CASE WHEN bank > 0 THEN 20 ELSE 0 END + CASE WHEN lines > 0 THEN 35 ELSE 0 END + CASE WHEN lines > 0 AND anomalies = 0 THEN 25 WHEN lines > 0 AND anomalies * 10 < lines THEN 15 ELSE 0 END + CASE WHEN status = 'in_review' AND anomalies = 0 THEN 15 ELSE 0 END + CASE WHEN status = 'in_review' THEN 5 ELSE 0 END) END"
PORTFOLIO = f"""{SUMMARY}, {PERIODS}, {ROLL},
act AS (SELECT client, unnest(arg_max({{'dossier': dossier, 'status': status, 'year': year, 'month': month}}, (CASE WHEN status <> 'exported' THEN 1 ELSE 0 END, updated_at, dossier))), count(*) FILTER (status <> 'exported') AS open FROM periods GROUP BY client),
pf1 AS (SELECT client, act.dossier, act.status, open, {COUNTED}, coalesce(active, 0) > 0 AS importing, CAST(ceil((epoch(make_date(year, month, 1) + INTERVAL 1 MONTH + INTERVAL 19 DAY + INTERVAL 86399 SECOND) - epoch(TIMESTAMP '{AS_OF}')) / 86400.0) AS INTEGER) AS days FROM act LEFT JOIN summary ON summary.dossier = act.dossier LEFT JOIN rolled ON rolled.dossier = act.dossier),
pf2 AS (SELECT *, {PROGRESS} AS progress FROM pf1),
pf AS (SELECT *, {PRIORITY} AS priority, {ACTION} AS action, days < 0 AND status <> 'exported' AS late, status = 'exported' AS done, status = 'in_review' OR anomalies > 0 AS validate FROM pf2)"""
#: Periods with their counts and what a cockpit derives.
COCKPIT = f"""{SUMMARY}, {PERIODS}, ck0 AS (SELECT periods.dossier, status, year, month, {COUNTED} FROM periods LEFT JOIN summary USING (dossier)),
ck AS (SELECT *, {PROGRESS} AS progress, {DAYS} AS days, bank > 0 OR bank_pending > 0 AS statement, lines > 0 OR invoices_pending > 0 OR documents > 0 AS invoices, bank_pending > 0 OR invoices_pending > 0 AS waiting, status = 'exported' AS exported FROM ck0)"""


def step(done: str, now: str) -> str:
    return f"CASE WHEN {done} THEN 'done' WHEN {now} THEN 'current' ELSE 'pending' END"


STEPS = " || ',' || ".join(f"'{k}:' || {step(done, now)}" for k, done, now in (
    ("bank", "statement", "NOT statement AND NOT exported"),
    ("purchases", "invoices", "NOT waiting AND NOT exported AND statement AND NOT invoices AND NOT (lines > 0 OR bank > 0 OR documents > 0)"),
    ("analysis", "NOT waiting AND NOT exported AND (lines > 0 OR bank > 0 OR NOT statement)", "waiting AND NOT exported"),
    ("review", "lines > 0 AND anomalies = 0", "NOT waiting AND NOT exported AND (lines > 0 OR bank > 0 OR documents > 0) AND (lines = 0 OR anomalies > 0)"),
    ("export", "exported", "lines > 0 AND anomalies = 0 AND NOT exported"),
))
M2 = "DECIMAL(18,2)"
TOTALS = f"""{D.ORDERS}, ot0 AS (SELECT month, half, count(*) AS orders, count(*) FILTER (status = 'DELIVERED') AS delivered, CAST(sum(CASE WHEN status = 'DELIVERED' THEN amount ELSE 0 END) AS {M2}) AS collected, CAST(sum(fee) AS {M2}) AS fees FROM porders GROUP BY month, half), ot AS (SELECT *, CAST(round(fees * CAST(1.20 AS DECIMAL(3,2)), 2) AS {M2}) AS fees_ttc FROM ot0),
st0 AS (SELECT month, half, count(*) FILTER (NOT back) AS services, coalesce(CAST(sum(ht) FILTER (NOT back) AS {M2}), 0) AS services_ht, count(*) FILTER (back) AS refunds, coalesce(CAST(sum(ht) FILTER (back) AS {M2}), 0) AS refunds_ht FROM (SELECT month, half, ht, false AS back FROM services UNION ALL SELECT month, half, ht, true FROM refunds) GROUP BY month, half),
st1 AS (SELECT st0.*, coalesce(s.collected, 0) AS collected, services_ht + refunds_ht AS billed, coalesce(invoice_ttc, CAST(round((services_ht + refunds_ht) * CAST(1.20 AS DECIMAL(3,2)), 2) AS {M2})) AS billed_ttc, s.payout AS paid FROM st0 LEFT JOIN stated s USING (month, half)),
st AS (SELECT * EXCLUDE (paid), coalesce(abs(paid), collected - billed_ttc) AS payout FROM st1)"""
MATCH = "mt AS (SELECT coalesce(o.month, s.month) AS month, coalesce(o.half, s.half) AS half, coalesce(o.order_id, s.order_id) AS order_id, s.ht AS billed, CASE WHEN status IS NULL THEN 'not in orders' WHEN s.ht IS NULL AND (status = 'DELIVERED' OR fee > 0) THEN 'not billed' WHEN s.ht IS NULL THEN 'not expected' WHEN abs(s.ht - fee) > 0.02 THEN 'other fee' ELSE 'equal' END AS kind FROM porders o FULL JOIN services s ON o.month = s.month AND o.half = s.half AND o.order_id = s.order_id)"
COUNTS, AMOUNTS = ["orders", "services", "refunds", "extra", "unbilled", "other_fee"], ["collected", "fees", "refunds_ht", "delta", "delta_after", "collected_delta", "payout_delta"]
RECONCILED = f"""{TOTALS}, {MATCH},
m AS (SELECT month, half, count(*) FILTER (kind = 'not in orders') AS extra, count(*) FILTER (kind = 'not billed') AS unbilled, count(*) FILTER (kind = 'other fee') AS other_fee, coalesce(sum(billed) FILTER (kind = 'not in orders'), 0) AS extra_fees, coalesce(sum(round(billed * CAST(1.20 AS DECIMAL(3,2)), 2)) FILTER (kind = 'not in orders'), 0) AS extra_ttc FROM mt GROUP BY month, half),
r1 AS (SELECT month, half, orders, services, refunds, extra, unbilled, other_fee, ot.collected, fees, refunds_ht, extra_ttc, fees_ttc, billed_ttc, st.collected AS stated, st.payout AS paid, billed - fees AS delta, billed - fees - extra_fees AS delta_after, st.collected - ot.collected AS collected_delta, st.payout - (ot.collected - fees_ttc) AS payout_delta FROM ot JOIN st USING (month, half) JOIN m USING (month, half)),
r2 AS (SELECT *, refunds_ht <> 0 AND abs(delta - refunds_ht) <= 0.02 AS by_refunds FROM r1),
r3 AS (SELECT *, by_refunds AND abs(collected - billed_ttc - paid) <= 0.5 AS paid_by_refunds, extra > 0 AND abs(delta_after) <= 0.5 AND abs(stated - fees_ttc - extra_ttc - paid) <= 0.5 AS by_missing FROM r2),
r AS (SELECT *, array_to_string(list_filter([CASE WHEN refunds > 0 THEN 'refunds' END, CASE WHEN by_refunds THEN 'refunds-fees' END, CASE WHEN extra > 0 THEN 'missing-orders' END, CASE WHEN unbilled > 0 THEN 'missing-lines' END, CASE WHEN other_fee > 0 THEN 'fee-mismatch' END,
    CASE WHEN abs(collected_delta) > 0.02 THEN CASE WHEN extra > 0 THEN 'collected-missing-orders' ELSE 'collected-unexplained' END END, CASE WHEN abs(delta) > 0.02 AND abs(delta_after) <= 0.02 THEN 'fees-explained' END, CASE WHEN abs(delta) > 0.02 AND abs(delta_after) > 0.02 AND NOT by_refunds THEN 'fees-unexplained' END], lambda x: x IS NOT NULL), ',') AS explanations,
  CASE WHEN abs(payout_delta) <= 0.5 THEN 'none' WHEN paid_by_refunds THEN 'refunds' WHEN by_missing THEN 'missing-orders' ELSE 'unexplained' END AS gap,
  (abs(collected_delta) <= 0.5 OR by_missing) AND (abs(delta) <= 0.5 OR by_refunds OR abs(delta_after) <= 0.5) AND (abs(payout_delta) <= 0.5 OR by_missing OR paid_by_refunds) AND other_fee = 0 AND unbilled = 0 AS ok FROM r3)"""
SUPPLIER = f"{D.LINES}, sk AS (SELECT client, CASE WHEN ice_frs <> '' THEN 'ice:' || ice_frs WHEN if_number <> '' THEN 'if:' || if_number ELSE 'name:' || {key_sql('lib_frss')} END AS key, CAST(year(date_fac) AS INTEGER) AS year, CAST(month(date_fac) AS INTEGER) AS month, fact_num, CAST(sum(ttc) AS DECIMAL(18,2)) AS ttc FROM lines GROUP BY ALL)"

ORACLES = {
    "f15_ledger_summary": f"WITH {SUMMARY} SELECT * FROM summary",
    "f16_cockpit": f"WITH {D.LINES}, {PERIODS}, a AS (SELECT dossier, count(*) AS lines, count(*) FILTER (date_paie IS NULL) AS undated, array_to_string(list_sort(list_distinct(list(fact_num)))[:3], ',') AS refs FROM lines GROUP BY dossier) SELECT dossier, status, coalesce(lines, 0) AS lines, coalesce(undated, 0) AS undated, coalesce(refs, '') AS refs FROM periods LEFT JOIN a USING (dossier)",
    "g05_active_period": f"WITH {PERIODS} SELECT client, dossier, status FROM periods QUALIFY row_number() OVER (PARTITION BY client ORDER BY CASE WHEN status <> 'exported' THEN 1 ELSE 0 END DESC, updated_at DESC, dossier DESC) = 1",
    "f19_client_stats": f"WITH {PERIODS} SELECT client, count(*) AS periods, count(*) FILTER (status <> 'exported') AS open, strftime(max(updated_at), '%Y-%m-%d') AS last, arg_max(status, year * 100 + month) AS last_status FROM periods GROUP BY client",
    "f20_year_grid": f"WITH {PERIODS}, m AS (SELECT DISTINCT client, year, CAST(unnest(range(1, 13)) AS INTEGER) AS month FROM periods) SELECT client, year, month, status FROM m LEFT JOIN periods USING (client, year, month)",
    "f30_periods_by_year": f"WITH {PERIODS} SELECT client, year, string_agg(month, ',' ORDER BY month DESC) AS months FROM periods GROUP BY client, year",
    "e16_portfolio": f"WITH {PORTFOLIO} SELECT {', '.join(COLUMNS)} FROM pf",
    "f21_kpis": f"WITH {PORTFOLIO} SELECT count(*) FILTER (NOT done) AS active_clients, CAST(sum(open) AS BIGINT) AS open_periods, CAST(sum(anomalies) AS BIGINT) AS anomalies, count(*) FILTER (done) AS exported, count(*) FILTER (late) AS late, count(*) FILTER (importing) AS imports FROM pf",
    "h01_portfolio_order": f"WITH {PORTFOLIO} SELECT client, row_number() OVER (ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'normal' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, anomalies DESC, client) AS position FROM pf",
    "h02_portfolio_filters": f"WITH {PORTFOLIO} SELECT client, 'all' AS filter FROM pf UNION ALL SELECT client, 'priority' FROM pf WHERE priority IN ('critical', 'high') UNION ALL SELECT client, 'late' FROM pf WHERE late UNION ALL SELECT client, 'validate' FROM pf WHERE validate AND NOT done UNION ALL SELECT client, 'done' FROM pf WHERE done",
    "j06_progress": f"WITH {SUMMARY}, {PERIODS}, x AS (SELECT dossier, status, coalesce(lines, 0) AS lines, coalesce(bank, 0) AS bank, coalesce(anomalies, 0) AS anomalies FROM periods LEFT JOIN summary USING (dossier)) SELECT dossier, {PROGRESS} AS progress FROM x",
    "j08_next_action": f"WITH {COCKPIT} SELECT dossier, {ACTION} AS action FROM ck",
    "j09_cockpit": f"WITH {COCKPIT} SELECT dossier, lines + bank AS operations, progress, days, {PRIORITY} AS priority, days < 0 AND NOT exported AS late, {ACTION} AS action, {STEPS} AS steps FROM ck",
    "j10_jobs": f"WITH {D.JOBS}, x AS (SELECT *, epoch(TIMESTAMP '{AS_OF}') - floor(epoch(touched_at)) AS idle, CASE status WHEN 'uploading' THEN CASE WHEN uploaded > 0 THEN 300 ELSE 90 END WHEN 'queued' THEN CASE WHEN processed > 0 THEN 120 WHEN from_documents THEN 900 ELSE 120 END WHEN 'processing' THEN CASE WHEN processed > 0 THEN 1200 WHEN from_documents THEN 1500 ELSE 480 END END AS lim FROM jobs), y AS (SELECT *, coalesce(idle > lim, false) AS stale FROM x) SELECT job, CAST(CASE WHEN total <= 0 THEN 0 WHEN status = 'uploading' THEN round(uploaded * 100.0 / total) WHEN status IN ('processing', 'done', 'failed') THEN round(processed * 100.0 / total) WHEN status = 'queued' AND uploaded < total THEN round(uploaded * 100.0 / total) ELSE 0 END AS INTEGER) AS progress, stale, status IN ('uploading', 'queued', 'processing') AND NOT stale AS active FROM y",
    "f22_roll_up_jobs": f"WITH {ROLL} SELECT * REPLACE (CAST(total AS BIGINT) AS total, CAST(processed AS BIGINT) AS processed) FROM rolled",
    "f23_import_summary": f"WITH {D.JOBS}, x AS (SELECT dossier, CAST(sum(processed) AS BIGINT) AS processed, CAST(sum(failed) AS BIGINT) AS failed, count(*) AS jobs FROM jobs GROUP BY dossier) SELECT *, CASE WHEN failed = 0 THEN 'done' WHEN processed > 0 THEN 'partial' ELSE 'failed' END AS result FROM x",
    "k02_sweep": f"WITH {D.JOBS}, x AS (SELECT *, epoch(TIMESTAMP '{AS_OF}') - floor(epoch(touched_at)) AS idle FROM jobs) SELECT job, status, CASE WHEN status = 'uploading' AND total = 0 AND idle > 300 THEN 'failed' WHEN status = 'uploading' AND total > 0 AND idle > 90 THEN 'queued' WHEN status = 'processing' AND idle > 1800 THEN 'queued' ELSE status END AS next FROM x",
    "h04_activity": "SELECT user_id AS dossier, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events QUALIFY rank <= 20",
    "h05_queue": f"WITH {D.JOBS} SELECT job, dossier FROM jobs WHERE status = 'queued' ORDER BY created_at, job LIMIT 10",
    "h07_jobs": f"WITH {D.JOBS} SELECT dossier, job, row_number() OVER (PARTITION BY dossier ORDER BY created_at DESC, job DESC) AS rank FROM jobs WHERE status IN ('uploading', 'queued', 'processing') QUALIFY rank <= 10",
    "f10_order_totals": f"WITH {TOTALS} SELECT month, half, orders, delivered, CAST(collected AS DOUBLE) AS collected, CAST(fees AS DOUBLE) AS fees, CAST(fees_ttc AS DOUBLE) AS fees_ttc, CAST(collected - fees_ttc AS DOUBLE) AS payout FROM ot",
    "f11_invoice_totals": f"WITH {TOTALS} SELECT month, half, services, refunds, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in ('services_ht', 'refunds_ht', 'collected', 'billed', 'billed_ttc', 'payout'))} FROM st",
    "e13_match_orders": f"WITH {D.ORDERS}, {MATCH} SELECT month, half, order_id, kind FROM mt",
    "f12_reconcile": f"WITH {RECONCILED} SELECT month, half, {', '.join(COUNTS)}, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in AMOUNTS)}, explanations, gap, ok FROM r UNION ALL SELECT month, 'all', {', '.join(f'CAST(sum({c}) AS BIGINT)' for c in COUNTS)}, {', '.join(f'CAST(sum({c}) AS DOUBLE)' for c in AMOUNTS)}, '', NULL, bool_and(ok) FROM r GROUP BY month",
    "f18_suppliers": f"WITH {SUPPLIER}, tree AS (SELECT client, key, year, month, count(*) AS invoices, CAST(sum(ttc) AS DOUBLE) AS ttc, list(year || ':' || month || ':' || fact_num || ':' || CAST(ttc AS VARCHAR) ORDER BY year DESC, month DESC, fact_num) AS every FROM sk GROUP BY GROUPING SETS ((client, key), (client, key, year), (client, key, year, month))) SELECT client, key, year, month, invoices, ttc, array_to_string(every[1:10], ';') AS listed FROM tree",
    "f18_supplier_invoices": f"WITH {SUPPLIER} SELECT client, key, year, month, fact_num, CAST(ttc AS DOUBLE) AS ttc FROM sk",
    "e07_official_names": f"WITH {D.LINES}, {NOTEBOOK}, a AS (SELECT client, ice, arg_max(name, entry) AS n1 FROM nb WHERE ice <> '' GROUP BY ALL), b AS (SELECT client, fiscal, arg_max(name, entry) AS n2 FROM nb GROUP BY ALL) SELECT dossier, pos, coalesce(n1, n2, lib_frss) AS lib_frss, coalesce(n1, n2, lib_frss) <> lib_frss AS changed FROM lines LEFT JOIN a ON a.client = lines.client AND a.ice = ice_frs LEFT JOIN b ON b.client = lines.client AND b.fiscal = if_number",
    "e20_merge_notebook": f"WITH {D.LINES}, {NOTEBOOK}, u AS (SELECT *, entry % 2 AS o, CASE WHEN ice <> '' THEN 'ice:' || ice ELSE 'if:' || fiscal END AS k FROM nb) SELECT client, max(ice) AS ice, arg_max(fiscal, (CASE WHEN fiscal <> '' THEN 1 ELSE 0 END, o, entry)) AS fiscal, arg_max(CASE WHEN o = 1 THEN name || ' SARL' ELSE name END, (o, entry)) AS name FROM u GROUP BY client, k",
    "h03_supplier_search": f"WITH {D.LINES} SELECT client, {key_sql('lib_frss')} AS key, CAST(sum(ttc) AS DOUBLE) AS ttc FROM lines WHERE contains(lower(lib_frss || ' ' || ice_frs || ' ' || if_number), '0003') GROUP BY ALL",
    "e19_visible": "SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS orders FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)) GROUP BY 1",
    "e22_firms": "SELECT n_name, owner FROM nation LEFT JOIN (SELECT c_nationkey, arg_min(c_name, c_custkey) AS owner FROM customer WHERE c_acctbal > 0 GROUP BY 1) ON n_nationkey = c_nationkey",
    "e21_clients": f"WITH {PERIODS} SELECT client, string_agg(year || ':' || month || ':' || status, ' ' ORDER BY year DESC, month DESC) AS periods FROM periods GROUP BY client",
}
