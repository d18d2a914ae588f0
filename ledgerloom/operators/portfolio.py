"""Periods, progress, priorities, import jobs, and reconciliation of delivery orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.functions.lineage import cut_in_order
from ledgerloom.functions.scalars import MONEY

# Seconds without a sign of life after which a job counts as stale, by state: once something is done, and before;
# the third where the job reads documents that are stored already.
STALE = {"uploading": (300, 90, 90), "queued": (120, 120, 900), "processing": (1200, 480, 1500)}
ACTIVE = list(STALE)
#: Strongest state first.
STRENGTH = {"processing": 3, "queued": 2, "uploading": 1}


def progress(status: Column, lines: Column, bank: Column, anomalies: Column) -> Column:
    """Score of a period from 0 to 99, 100 once exported."""
    clean = anomalies == 0
    parts = [
        F.when(bank > 0, 20), F.when(lines > 0, 35), F.when((lines > 0) & clean, 25).when((lines > 0) & (anomalies * 10 < lines), 15),
        F.when((status == "in_review") & clean, 15), F.when(status == "in_review", 5),
    ]
    total = sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0))
    return F.when(status == "exported", 100).otherwise(F.least(total, F.lit(99)))


def priority(status: Column, progressed: Column, anomalies: Column, days: Column) -> Column:
    """Class of a period."""
    return (
        F.when(status == "exported", "done").when((days <= 7) | (anomalies >= 5), "critical")
        .when((days <= 14) | (anomalies > 0) | (status == "in_review"), "high").when(progressed > 0, "normal").otherwise("low")
    )


def next_action(status: Column, lines: Column, bank: Column, anomalies: Column, bank_pending: Column, invoices_pending: Column, documents: Column) -> Column:
    """What to do next in a period (J8); a null status is a client without one.

    ``bank_pending, invoices_pending``: documents not read yet; ``documents``:
    invoice documents there are.
    """
    pending = bank_pending + invoices_pending
    return (
        F.when(status.isNull(), "create_period").when(status == "exported", "done")
        .when((bank == 0) & (bank_pending == 0), "bank").when((bank == 0) & (lines == 0), "extract_bank")
        .when((lines == 0) & (pending > 0), "analysis").when((lines == 0) & (bank > 0) & (documents > 0), "bank_match")
        .when((lines == 0) & ((bank > 0) | (documents > 0)), "review").when(lines == 0, "purchases")
        .when(anomalies > 0, "fix").otherwise("declare")
    )


def pipeline_steps(status: Column, lines: Column, bank: Column, anomalies: Column, bank_pending: Column, invoices_pending: Column, documents: Column) -> Column:
    """States of a period's five steps (J9): ``array<struct<step, state>>``, each done, current or pending."""
    exported, has_bank, has_lines = status == "exported", bank > 0, lines > 0
    statement = has_bank | (bank_pending > 0)
    invoices = has_lines | (invoices_pending > 0) | (documents > 0)
    waiting = (bank_pending > 0) | (invoices_pending > 0)
    settled = ~waiting & ~exported
    ready = settled & (has_lines | has_bank | (documents > 0))
    steps = {
        "bank": (statement, ~statement & ~exported),
        "purchases": (invoices, settled & statement & ~invoices & ~ready),
        "analysis": (settled & (has_lines | has_bank | ~statement), waiting & ~exported),
        "review": (has_lines & (anomalies == 0), ready & F.when(has_lines, anomalies > 0).otherwise(True)),
        "export": (exported, has_lines & (anomalies == 0) & ~exported),
    }
    return F.array(*[F.struct(F.lit(k).alias("step"), F.when(done, "done").when(now, "current").otherwise("pending").alias("state")) for k, (done, now) in steps.items()])


#: Counts of a period that a cockpit needs, zero where it has none.
COUNTS = ["lines", "bank", "anomalies", "bank_pending", "invoices_pending", "documents"]


def cockpit(periods: DataFrame, summary: DataFrame, as_of: Column) -> DataFrame:
    """Cockpit state of every period (J9): counts, progress, days, priority, next action and steps."""
    c = [F.col("status"), *[F.col(k) for k in COUNTS]]
    df = periods.join(summary, "dossier", "left").fillna(0, COUNTS)
    df = df.withColumns({"progress": progress(*c[:4]), "days": S.days_left(F.col("year"), F.col("month"), as_of), "action": next_action(*c), "steps": pipeline_steps(*c), "operations": F.col("lines") + F.col("bank")})
    return df.withColumns({"priority": priority(F.col("status"), F.col("progress"), F.col("anomalies"), F.col("days")), "late": (F.col("days") < 0) & (F.col("status") != "exported")})


def active_period(periods: DataFrame) -> DataFrame:
    """Newest open period of each client, else the newest."""
    open_first = F.struct((F.col("status") != "exported").cast("int"), F.col("updated_at"), F.col("dossier"))
    return periods.groupBy("client").agg(F.max_by(F.struct("dossier", "status", "updated_at", "year", "month"), open_first).alias("p")).select("client", "p.*")


def client_stats(periods: DataFrame) -> DataFrame:
    """Periods, open ones, last activity and last status of each client."""
    return periods.groupBy("client").agg(F.count("*").alias("periods"), F.count_if(F.col("status") != "exported").alias("open"), F.max("updated_at").alias("last"), F.max_by("status", F.struct("year", "month")).alias("last_status"))


def year_grid(periods: DataFrame) -> DataFrame:
    """Twelve months of each client and year with the status, empty where there is no period."""
    months = periods.select("client", "year").distinct().withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return months.join(periods.select("client", "year", "month", "status"), ["client", "year", "month"], "left")


def portfolio(periods: DataFrame, summary: DataFrame, jobs: DataFrame, as_of: Column) -> DataFrame:
    """One row per client: the cockpit of its active period, its open periods and running imports."""
    opened = periods.groupBy("client").agg(F.count_if(F.col("status") != "exported").alias("open"))
    p = cockpit(active_period(periods), summary, as_of).join(jobs, "dossier", "left").join(opened, "client")
    return p.withColumns({"done": F.col("status") == "exported", "validate": (F.col("status") == "in_review") | (F.col("anomalies") > 0), "importing": F.coalesce(F.col("active"), F.lit(0)) > 0})


def ranked(df: DataFrame, order: list[Column], into: str = "position") -> DataFrame:
    """Position of each row in an overall order (H1): rows are sorted by range, and each partition counts on from those before it."""
    sorted_rows = cut_in_order(df.orderBy(*order)).withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    before = sorted_rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = before.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = sorted_rows.withColumn("__part", part).join(before, "__part")
    return at.withColumn(into, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__at", "__part", "__n", "__before")


def priority_rank(c: Column) -> Column:
    return F.when(c == "critical", 0).when(c == "high", 1).when(c == "normal", 2).when(c == "low", 3).otherwise(4)


def kpis(rows: DataFrame) -> DataFrame:
    """Figures of the whole portfolio."""
    return rows.agg(F.count_if(~F.col("done")).alias("active_clients"), F.sum("open").alias("open_periods"), F.sum("anomalies").alias("anomalies"), F.count_if("done").alias("exported"), F.count_if("late").alias("late"), F.count_if("importing").alias("imports"))


# Import jobs ---------------------------------------------------------------
def active_jobs(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Jobs with their progress and whether they are active or stale.

    ``uploaded, processed``: files so far; ``from_documents``: the job reads
    stored documents. A job never touched is stale.
    """
    C = F.col
    idle = F.unix_timestamp(as_of) - F.unix_timestamp("touched_at")
    begun = F.when(C("status") == "uploading", C("uploaded") > 0).otherwise(C("processed") > 0)
    limit = F.coalesce(*[F.when(C("status") == s, F.when(begun, late).when(C("from_documents"), stored).otherwise(early)) for s, (late, early, stored) in STALE.items()])
    share = lambda c: F.round(C(c) * 100 / C("total"))
    done = (
        F.when(C("total") <= 0, 0).when(C("status") == "uploading", share("uploaded")).when(C("status").isin("processing", "done", "failed"), share("processed"))
        .when((C("status") == "queued") & (C("uploaded") < C("total")), share("uploaded")).otherwise(0)
    )
    stale = C("touched_at").isNull() | F.coalesce(idle > limit, F.lit(False))
    return jobs.withColumns({"progress": done.cast("int"), "stale": stale, "active": C("status").isin(ACTIVE) & ~stale})


def roll_up_jobs(jobs: DataFrame) -> DataFrame:
    """Active jobs of each dossier in one row: summed counters, strongest state, the newest job."""
    strength = F.coalesce(*[F.when(F.col("status") == s, n) for s, n in STRENGTH.items()])
    return jobs.where(F.col("status").isin(ACTIVE)).groupBy("dossier").agg(F.count("*").alias("active"), F.sum("total").alias("total"), F.sum("processed").alias("processed"), F.max_by("status", strength).alias("status"), F.max_by("job", F.struct("created_at", "job")).alias("newest"))


def sweep(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Next state of stale jobs (K2): empty uploads fail after 300 s, partial ones queue after 90 s, processing starts over after 1800 s."""
    idle = F.unix_timestamp(as_of) - F.unix_timestamp("touched_at")
    up = F.col("status") == "uploading"
    after = F.when(up & (F.col("total") == 0) & (idle > 300), "failed").when(up & (F.col("total") > 0) & (idle > 90), "queued").when((F.col("status") == "processing") & (idle > 1800), "queued").otherwise(F.col("status"))
    return jobs.withColumn("next", after)


def import_summary(jobs: DataFrame) -> DataFrame:
    """Files by outcome and final state of each dossier's jobs."""
    return jobs.groupBy("dossier").agg(F.sum("processed").alias("processed"), F.sum("failed").alias("failed"), F.count("*").alias("jobs")).withColumn("result", F.when(F.col("failed") == 0, "done").when(F.col("processed") > 0, "partial").otherwise("failed"))


def newest(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """First n rows of each key; the limit is pushed below the shuffle (H4, H7)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


# Delivery platform -----------------------------------------------------------
#: VAT of delivery fees, in percent; largest difference of a fee; of totals that still count as explained.
FEE_VAT, FEE_TOLERANCE, TOTAL_TOLERANCE = 20, "0.02", "0.50"


def order_totals(orders: DataFrame) -> DataFrame:
    """Orders of each half-month: collected by delivered ones, fees of all, payout."""
    got = S.delivered(F.col("status"))
    out = orders.groupBy("month", "half").agg(F.count("*").alias("orders"), F.count_if(got).alias("delivered"), F.sum(F.when(got, F.col("amount")).otherwise(0)).cast(MONEY).alias("collected"), F.sum("fee").cast(MONEY).alias("fees"))
    out = out.withColumn("fees_ttc", F.round(F.col("fees") * F.lit("1.20").cast("decimal(3,2)"), 2).cast(MONEY))
    return out.withColumn("payout", (F.col("collected") - F.col("fees_ttc")).cast(MONEY))


def invoice_totals(services: DataFrame, refunds: DataFrame, summary: DataFrame) -> DataFrame:
    """Delivery invoice of each half-month (F11): services and refunds without tax, total, collected, payout.

    ``summary(month, half, invoice_ttc, collected, payout)`` is what the invoice
    states; what it does not is computed. A negative payout is money received.
    """
    by = ["month", "half"]
    s = services.groupBy(*by).agg(F.count("*").alias("services"), F.sum("ht").cast(MONEY).alias("services_ht"))
    r = refunds.groupBy(*by).agg(F.count("*").alias("refunds"), F.sum("ht").cast(MONEY).alias("refunds_ht"))
    zero = F.lit(0).cast(MONEY)
    out = s.join(r, by, "full_outer").join(summary, by, "left").fillna(0, ["services", "refunds"]).withColumns({"services_ht": F.coalesce("services_ht", zero), "refunds_ht": F.coalesce("refunds_ht", zero), "collected": F.coalesce("collected", zero)})
    out = out.withColumn("billed", (F.col("services_ht") + F.col("refunds_ht")).cast(MONEY))
    out = out.withColumn("billed_ttc", F.coalesce("invoice_ttc", F.round(F.col("billed") * F.lit("1.20").cast("decimal(3,2)"), 2).cast(MONEY)))
    return out.withColumn("payout", F.coalesce(F.abs("payout"), (F.col("collected") - F.col("billed_ttc")).cast(MONEY))).drop("invoice_ttc")


def match_orders(orders: DataFrame, services: DataFrame) -> DataFrame:
    """Orders and billed services side by side, classified (E13): missing on a side, another fee, or equal."""
    on_invoice = S.delivered(F.col("status")) | (F.col("fee") > 0)
    o = orders.select("month", "half", "order_id", "status", "fee", on_invoice.alias("expected"))
    both = o.join(services.select("month", "half", "order_id", F.col("ht").alias("billed")), ["month", "half", "order_id"], "full_outer")
    kind = F.when(F.col("status").isNull(), "not in orders").when(F.col("billed").isNull() & F.col("expected"), "not billed").when(F.col("billed").isNull(), "not expected").when(F.abs(F.col("billed") - F.col("fee")) > F.lit(FEE_TOLERANCE).cast(MONEY), "other fee").otherwise("equal")
    return both.withColumn("kind", kind)


def reconcile(orders: DataFrame, services: DataFrame, refunds: DataFrame, summary: DataFrame) -> DataFrame:
    """Half-months that have an invoice, and their months, with differences, whether they are explained, and how.

    ``explanations``: kinds in order; ``gap``: why the payout differs; ``ok``:
    fees, collected and payout agree or are explained, and no order lacks its
    line or has another fee. A month is ok if all its halves are.
    """
    C, by = F.col, ["month", "half"]
    ttc = F.round(C("billed") * F.lit("1.20").cast("decimal(3,2)"), 2)
    extra = C("kind") == "not in orders"
    m = match_orders(orders, services).groupBy(*by).agg(
        F.count_if(extra).alias("extra"), F.count_if(C("kind") == "not billed").alias("unbilled"), F.count_if(C("kind") == "other fee").alias("other_fee"),
        F.sum(F.when(extra, C("billed")).otherwise(0)).cast(MONEY).alias("extra_fees"), F.sum(F.when(extra, ttc).otherwise(0)).cast(MONEY).alias("extra_ttc"),
    )
    billed = invoice_totals(services, refunds, summary).withColumnsRenamed({"collected": "stated", "payout": "paid"})
    rows = billed.join(order_totals(orders), by).join(m, by)
    close = lambda x, by=FEE_TOLERANCE: F.abs(x) <= F.lit(by).cast(MONEY)
    near = lambda x: close(x, TOTAL_TOLERANCE)
    rows = rows.withColumns({"delta": (C("billed") - C("fees")).cast(MONEY), "collected_delta": (C("stated") - C("collected")).cast(MONEY), "payout_delta": (C("paid") - C("payout")).cast(MONEY)})
    rows = rows.withColumn("delta_after", (C("delta") - C("extra_fees")).cast(MONEY))
    rows = rows.withColumn("by_refunds", (C("refunds_ht") != 0) & close(C("delta") - C("refunds_ht")))
    rows = rows.withColumns({
        "paid_by_refunds": C("by_refunds") & near(C("collected") - C("billed_ttc") - C("paid")),
        "by_missing": (C("extra") > 0) & near(C("delta_after")) & near(C("stated") - C("fees_ttc") - C("extra_ttc") - C("paid")),
    })
    fees_ok = near(C("delta")) | C("by_refunds") | near(C("delta_after"))
    collected_ok, paid_ok = near(C("collected_delta")) | C("by_missing"), near(C("payout_delta")) | C("by_missing") | C("paid_by_refunds")
    kinds = [
        (C("refunds") > 0, "refunds"), (C("by_refunds"), "refunds-fees"), (C("extra") > 0, "missing-orders"), (C("unbilled") > 0, "missing-lines"), (C("other_fee") > 0, "fee-mismatch"),
        (~close(C("collected_delta")), F.when(C("extra") > 0, "collected-missing-orders").otherwise("collected-unexplained")),
        (~close(C("delta")) & close(C("delta_after")), "fees-explained"), (~close(C("delta")) & ~close(C("delta_after")) & ~C("by_refunds"), "fees-unexplained"),
    ]
    rows = rows.withColumns({
        "explanations": F.array_compact(F.array(*[F.when(test, kind) for test, kind in kinds])),
        "gap": F.when(near(C("payout_delta")), "none").when(C("paid_by_refunds"), "refunds").when(C("by_missing"), "missing-orders").otherwise("unexplained"),
        "ok": collected_ok & fees_ok & paid_ok & (C("other_fee") == 0) & (C("unbilled") == 0),
    })
    sums = ["orders", "services", "refunds", "extra", "unbilled", "other_fee", "collected", "fees", "refunds_ht", "delta", "delta_after", "collected_delta", "payout_delta"]
    months = rows.groupBy("month").agg(*[F.sum(c).alias(c) for c in sums], F.every("ok").alias("ok")).withColumns({"half": F.lit("all"), "explanations": F.array().cast("array<string>"), "gap": F.lit(None).cast("string")})
    return rows.select(*by, *sums, "explanations", "gap", "ok").unionByName(months)


# Suppliers -------------------------------------------------------------------
#: Invoices listed with a supplier, a year or a month of the tree.
LISTED = 10


def supplier_invoices(lines: DataFrame) -> DataFrame:
    """Invoices of each supplier of a client: ``client, key, year, month, fact_num, ttc``.

    Identity is the company id, else the fiscal id, else the name key.
    """
    key = F.when(S.ice(F.col("ice_frs")) != "", F.concat(F.lit("ice:"), "ice_frs")).when(F.col("if_number") != "", F.concat(F.lit("if:"), "if_number")).otherwise(F.concat(F.lit("name:"), S.supplier_key(F.col("lib_frss"))))
    base = lines.select("client", key.alias("key"), F.year("date_fac").alias("year"), F.month("date_fac").alias("month"), "fact_num", "ttc")
    return base.groupBy("client", "key", "year", "month", "fact_num").agg(F.sum("ttc").cast(MONEY).alias("ttc"))


def supplier_tree(lines: DataFrame) -> DataFrame:
    """Suppliers of a client, their years and months (F18): how many invoices, their TTC, and the newest ``LISTED`` of them nested.

    A node's list is made of its children's: months keep their first numbers,
    years and suppliers the newest of those, so no supplier is ever collected
    whole. All invoices are the rows of :func:`supplier_invoices`.
    """
    levels = [["client", "key"], ["client", "key", "year"], ["client", "key", "year", "month"]]
    # one row per invoice first: distinct counts need no expansion later
    per = supplier_invoices(lines)
    month = per.groupBy(*levels[2]).agg(F.count("*").alias("invoices"), F.sum("ttc").alias("ttc"))
    counted = month.groupingSets(levels, *levels[2]).agg(F.sum("invoices").alias("invoices"), F.sum("ttc").alias("ttc"))
    newest, top, lists = [F.desc("year"), F.desc("month"), F.col("fact_num")], per, None
    for level in reversed(levels):
        top = top.withColumn("rank", F.row_number().over(Window.partitionBy(*level).orderBy(*newest))).where(F.col("rank") <= LISTED)
        node = top.groupBy(*level).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "year", "month", "fact_num", "ttc"))), lambda x: x.dropFields("rank")).alias("listed"))
        node = node.select("client", "key", *[F.col(c) if c in level else F.lit(None).cast("int").alias(c) for c in ("year", "month")], "listed")
        lists = node if lists is None else lists.unionByName(node)
        top = top.drop("rank")
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"l.{c}")) for c in levels[2]]
    return counted.alias("c").join(lists.alias("l"), same).select("c.*", "l.listed")


def official_names(lines: DataFrame, notebook: DataFrame) -> DataFrame:
    """Names from the supplier notebook by company id, else by fiscal id; the last entry of an id wins, of equal ones the greatest name."""
    by_ice = notebook.where("ice <> ''").groupBy("client", "ice").agg(F.max_by("name", F.struct("entry", "name")).alias("n1"))
    by_if = notebook.where("fiscal <> ''").groupBy("client", "fiscal").agg(F.max_by("name", F.struct("entry", "name")).alias("n2"))
    keyed = lines.withColumns({"ice": S.ice(F.col("ice_frs")), "fiscal": S.fiscal_id(F.col("if_number"))})
    out = keyed.join(by_ice, ["client", "ice"], "left").join(by_if, ["client", "fiscal"], "left")
    name = F.coalesce("n1", "n2", "lib_frss")
    return out.withColumns({"changed": name != F.col("lib_frss"), "lib_frss": name}).select(*lines.columns, "changed")


def merge_notebook(notebook: DataFrame, new: DataFrame) -> DataFrame:
    """Notebook after an upsert keyed by company id, else fiscal id; known ids and later names are kept, of equally late values the greatest."""
    both = notebook.withColumn("o", F.lit(0)).unionByName(new.withColumn("o", F.lit(1)))
    key = F.when(F.col("ice") != "", F.concat(F.lit("ice:"), "ice")).otherwise(F.concat(F.lit("if:"), "fiscal"))
    order = F.struct("o", "entry")
    return both.withColumn("k", key).groupBy("client", "k").agg(F.max("ice").alias("ice"), F.max_by(F.col("fiscal"), F.struct((F.col("fiscal") != "").cast("int"), order, "fiscal")).alias("fiscal"), F.max_by("name", F.struct(order, "name")).alias("name")).drop("k")
