"""Ledger tables derived from the driver's star schema, each with a DuckDB twin.

Invoices come from line items, payments from orders, import jobs from events,
documents and archives from pages and line items. Everything is a projection
of the given rows, so work grows with them; each twin is the same definition
in SQL, as common table expressions that oracle queries start with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import MONEY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "copy"]


def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines of many periods (``dossier``: one client and month), some damaged, some repeated."""
    items = table(spark, sf_dir, "lineitem")
    items = items.withColumn("copy", F.explode(F.when(F.col("l_partkey") % 19 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    known = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey").alias("known"))  # one row
    # numbered within each order: the partitioning by order key serves the join with orders as well
    items = items.withColumn("pos", F.col("l_orderkey") * 1000 + F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)))
    # orders meet their supplier before they meet the lines, so that many suppliers do not deal all lines again
    issued = orders.join(F.broadcast(known)).withColumn("issuer", F.col("o_orderkey") % (F.col("known") + 1)).join(suppliers, F.col("s_suppkey") == F.col("issuer"))
    rows = items.join(issued, F.col("l_orderkey") == F.col("o_orderkey"))
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    blend = p % 59 == 0  # several rates summed up in one line
    pct = F.when(F.col("l_tax") < 0.03, 0).when(F.col("l_tax") < 0.06, 10).otherwise(20)
    ht = F.round(F.col("l_extendedprice").cast(MONEY) * (1 - F.col("l_discount").cast("decimal(3,2)")), 2).cast(MONEY)
    tva = F.round(F.col("true_ht") * F.when(F.col("pct") == 10, F.lit("0.10")).when(F.col("pct") == 20, F.lit("0.20")).otherwise("0.00").cast("decimal(3,2)"), 2).cast(MONEY)
    number = F.concat(F.when(k % 29 == 0, "AVOIR").otherwise("F"), k.cast("string"))
    name = F.concat("s_name", F.when(p % 4 == 0, " SARL").when(p % 4 == 1, " S.A.").when(p % 4 == 2, "").otherwise(" Société"))
    tva_id = F.when(p % 7 == 0, "").when(p % 31 == 0, F.lpad((F.col("s_suppkey") + 901).cast("string"), 15, "0")).otherwise(F.lpad((F.col("s_suppkey") + 1).cast("string"), 15, "0"))
    return (
        rows.withColumn("pct", pct)
        .withColumn("true_ht", ht)
        .withColumn("true_tva", tva)
        .withColumn("mixed_tva", F.round(F.col("true_ht") * F.lit("0.15").cast("decimal(3,2)"), 2).cast(MONEY))
        .withColumn("dossier", F.floor(F.col("o_custkey") / 300) * 1000 + (F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate"))
        .select(
            F.floor(F.col("o_custkey") / 300).alias("client"),
            "dossier",
            F.date_format("o_orderdate", "yyyy-MM").alias("period"),
            "pos",
            F.when(k % 3 == 0, F.concat(number, F.lit(".pdf"))).otherwise(F.concat(F.lit("factures/"), F.col("s_name"), F.lit("/"), number, F.lit(".pdf"))).alias("source_file"),
            F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("src-"), (k % 5000).cast("string"))).alias("source_id"),
            number.alias("fact_num"),
            F.when(p % 5 == 0, "PRESTATIONS").when(p % 5 == 1, "TELEPHONIE").when(p % 5 == 2, "FRAIS BANCAIRE").otherwise("MATIERES CONSOMMABLES").alias("designation"),
            F.when(blend, F.col("true_ht")).when(p % 17 == 0, F.lit(20).cast(MONEY)).when(p % 13 == 0, F.col("true_tva")).otherwise(F.col("true_ht")).alias("ht"),
            F.when(blend, F.col("mixed_tva")).when(p % 7 == 0, F.lit(0).cast(MONEY)).when(p % 13 == 0, F.col("true_ht")).when(p % 23 == 0, (-F.col("true_tva")).cast(MONEY)).otherwise(F.col("true_tva")).alias("tva"),
            F.when(blend, (F.col("true_ht") + F.col("mixed_tva")).cast(MONEY)).when(p % 11 == 0, F.lit(0).cast(MONEY)).otherwise((F.col("true_ht") + F.col("true_tva")).cast(MONEY)).alias("ttc"),
            "pct",
            name.alias("lib_frss"),
            tva_id.alias("ice_frs"),
            F.when(p % 6 == 0, "").otherwise((F.col("s_suppkey") + 40000000).cast("string")).alias("if_number"),
            F.to_date("o_orderdate").alias("date_fac"),
            F.when(p % 3 == 0, F.to_date("l_shipdate")).alias("date_paie"),
            F.when(k % 2 == 0, "ai").otherwise("pdf").alias("engine"),
            F.when(k % 5 == 0, "Scan difficile : relu").otherwise("").alias("warnings"),
            (p % 41 == 0).alias("from_folder"),
            (p % 43 == 0).alias("tva_calculated"),
            F.when(p % 37 == 0, F.array(F.lit("__line_review__"))).when(p % 29 == 0, F.array(F.lit("ice_frs"), F.lit("m_ht"))).otherwise(F.array().cast("array<string>")).alias("verified"),
            (p % 53 == 0).alias("dismissed"),
            "copy",
        )
    )


#: Twin of :func:`invoice_lines`.
LINES = """
lines AS (
  SELECT client, dossier, period, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate, copy) AS pos,
    CASE WHEN l_orderkey % 3 = 0 THEN fact_num || '.pdf' ELSE 'factures/' || s_name || '/' || fact_num || '.pdf' END AS source_file,
    CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE 'src-' || (l_orderkey % 5000) END AS source_id, fact_num,
    CASE l_partkey % 5 WHEN 0 THEN 'PRESTATIONS' WHEN 1 THEN 'TELEPHONIE' WHEN 2 THEN 'FRAIS BANCAIRE' ELSE 'MATIERES CONSOMMABLES' END AS designation,
    CASE WHEN l_partkey % 59 = 0 THEN true_ht WHEN l_partkey % 17 = 0 THEN CAST(20 AS DECIMAL(18,2)) WHEN l_partkey % 13 = 0 THEN true_tva ELSE true_ht END AS ht,
    CASE WHEN l_partkey % 59 = 0 THEN mixed_tva WHEN l_partkey % 7 = 0 THEN CAST(0 AS DECIMAL(18,2)) WHEN l_partkey % 13 = 0 THEN true_ht WHEN l_partkey % 23 = 0 THEN -true_tva ELSE true_tva END AS tva,
    CASE WHEN l_partkey % 59 = 0 THEN CAST(true_ht + mixed_tva AS DECIMAL(18,2)) WHEN l_partkey % 11 = 0 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(true_ht + true_tva AS DECIMAL(18,2)) END AS ttc, pct,
    s_name || CASE l_partkey % 4 WHEN 0 THEN ' SARL' WHEN 1 THEN ' S.A.' WHEN 2 THEN '' ELSE ' Société' END AS lib_frss,
    CASE WHEN l_partkey % 7 = 0 THEN '' WHEN l_partkey % 31 = 0 THEN lpad(CAST(s_suppkey + 901 AS VARCHAR), 15, '0') ELSE lpad(CAST(s_suppkey + 1 AS VARCHAR), 15, '0') END AS ice_frs,
    CASE WHEN l_partkey % 6 = 0 THEN '' ELSE CAST(s_suppkey + 40000000 AS VARCHAR) END AS if_number,
    CAST(o_orderdate AS DATE) AS date_fac, CASE WHEN l_partkey % 3 = 0 THEN CAST(l_shipdate AS DATE) END AS date_paie,
    CASE WHEN l_orderkey % 2 = 0 THEN 'ai' ELSE 'pdf' END AS engine, CASE WHEN l_orderkey % 5 = 0 THEN 'Scan difficile : relu' ELSE '' END AS warnings, l_partkey % 41 = 0 AS from_folder, l_partkey % 43 = 0 AS tva_calculated,
    CASE WHEN l_partkey % 37 = 0 THEN ['__line_review__'] WHEN l_partkey % 29 = 0 THEN ['ice_frs', 'm_ht'] ELSE [] END AS verified, l_partkey % 53 = 0 AS dismissed, copy
  FROM (
    SELECT *, CAST(round(true_ht * CAST(CASE pct WHEN 10 THEN 0.10 WHEN 20 THEN 0.20 ELSE 0.00 END AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS true_tva, CAST(round(true_ht * CAST(0.15 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS mixed_tva FROM (
      SELECT *, CASE WHEN l_tax < 0.03 THEN 0 WHEN l_tax < 0.06 THEN 10 ELSE 20 END AS pct,
        CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(3,2))), 2) AS DECIMAL(18,2)) AS true_ht,
        o_custkey // 300 AS client, (o_custkey // 300) * 1000 + (year(o_orderdate) - 1990) * 12 + month(o_orderdate) AS dossier, strftime(o_orderdate, '%Y-%m') AS period,
        CASE WHEN l_orderkey % 29 = 0 THEN 'AVOIR' ELSE 'F' END || l_orderkey AS fact_num
      FROM (SELECT *, unnest(CASE WHEN l_partkey % 19 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM lineitem) JOIN orders ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = o_orderkey % (SELECT max(s_suppkey) + 1 FROM supplier))))"""


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank movements: a payment for every third order, fees and credits among them; the label names the supplier, its number, or neither."""
    return payments_of(invoice_lines(spark, sf_dir))


def payments_of(lines: DataFrame) -> DataFrame:
    """:func:`payments` of given invoice lines."""
    k = F.substring("fact_num", 2, 20).try_cast("long")
    groups = lines.where(F.col("fact_num").startswith("F") & (F.col("copy") == 0)).groupBy("client", "dossier", "fact_num").agg(F.sum("ttc").cast(MONEY).alias("total"), F.min("lib_frss").alias("lib_frss"), F.max("date_fac").alias("date"))
    label = F.when(k % 10 == 0, "VIREMENT EMIS").when(k % 4 == 0, F.concat(F.lit("Virement en faveur de "), F.col("lib_frss"), F.lit(", BMCE"))).when(k % 4 == 1, F.concat(F.lit("Chèque "), F.col("fact_num"))).when(k % 7 == 0, "Commission tenue de compte").otherwise(F.concat(F.lit("Prélèvement "), F.col("lib_frss")))
    return groups.where((k % 3 == 0) & (F.col("total") > 0)).select("client", "dossier", F.concat(F.lit("T"), k.cast("string")).alias("txn"), F.date_add("date", 9).alias("date"), label.alias("label"), F.when(k % 11 == 0, F.col("total")).otherwise((-F.col("total")).cast(MONEY)).alias("amount"))


#: Twin of :func:`payments`; needs ``lines``.
PAYMENTS = """
payments AS (
  SELECT client, dossier, 'T' || k AS txn, CAST(date + 9 AS DATE) AS date,
    CASE WHEN k % 10 = 0 THEN 'VIREMENT EMIS' WHEN k % 4 = 0 THEN 'Virement en faveur de ' || lib_frss || ', BMCE' WHEN k % 4 = 1 THEN 'Chèque ' || fact_num WHEN k % 7 = 0 THEN 'Commission tenue de compte' ELSE 'Prélèvement ' || lib_frss END AS label,
    CASE WHEN k % 11 = 0 THEN total ELSE -total END AS amount
  FROM (SELECT client, dossier, fact_num, CAST(sum(ttc) AS DECIMAL(18,2)) AS total, min(lib_frss) AS lib_frss, max(date_fac) AS date, CAST(substr(fact_num, 2) AS BIGINT) AS k
        FROM lines WHERE fact_num LIKE 'F%' AND copy = 0 GROUP BY client, dossier, fact_num) WHERE k % 3 = 0 AND total > 0)"""


def import_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import jobs out of events: status from the event's type, counters from its value and properties."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "view", "processing").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "uploading").otherwise("done")
    n = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("event_id").alias("job"), F.col("user_id").alias("dossier"), F.col("ts").alias("created_at"), F.expr("ts + make_dt_interval(0, 0, 0, cast(event_id % 1500 as int))").alias("touched_at"), status.alias("status"), F.coalesce(n, F.lit(0)).alias("total"), F.floor(F.coalesce(n, F.lit(0)) * (F.col("event_id") % 4) / 3).cast("int").alias("processed"), (F.col("event_id") % 3 == 0).cast("int").alias("failed"), F.floor(F.coalesce(n, F.lit(0)) * (F.col("event_id") % 5) / 4).cast("int").alias("uploaded"), (F.col("event_id") % 2 == 0).alias("from_documents"))


JOBS = """
jobs AS (
  SELECT event_id AS job, user_id AS dossier, ts AS created_at, ts + to_seconds(event_id % 1500) AS touched_at,
    CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'uploading' ELSE 'done' END AS status,
    n AS total, CAST(floor(n * (event_id % 4) / 3) AS INTEGER) AS processed, CAST(event_id % 3 = 0 AS INTEGER) AS failed, CAST(floor(n * (event_id % 5) / 4) AS INTEGER) AS uploaded, event_id % 2 = 0 AS from_documents
  FROM (SELECT *, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS n FROM events))"""


def platform_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a delivery platform: status, amount, delivery fee without tax, half-month."""
    o = table(spark, sf_dir, "orders")
    day = F.dayofmonth("o_orderdate")
    return o.select(
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("order_id"),
        F.when(F.col("o_orderstatus") == "F", "DELIVERED").when(F.col("o_orderstatus") == "O", "RETURNED_TO_SHOP").otherwise("CANCELLED").alias("status"),
        F.col("o_totalprice").cast(MONEY).alias("amount"),
        F.round(F.col("o_totalprice").cast(MONEY) * F.lit("0.12").cast("decimal(3,2)"), 2).cast(MONEY).alias("fee"),
        F.col("o_orderdate").alias("created_at"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.when(day <= 15, "q1").otherwise("q2").alias("half"),
    )


def platform_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the platform billed: most orders, some at another fee, and some it alone knows."""
    o = platform_orders(spark, sf_dir)
    k = F.substring("order_id", 2, 20).cast("long")
    return o.where(k % 13 != 0).select(F.when(k % 31 == 0, F.concat(F.lit("X"), k.cast("string"))).otherwise(F.col("order_id")).alias("order_id"), "month", "half", F.when(k % 17 == 0, (F.col("fee") + 1).cast(MONEY)).otherwise(F.col("fee")).alias("ht"))


def platform_refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fees that the platform gave back, on the invoice only."""
    o = platform_orders(spark, sf_dir)
    return o.where(F.substring("order_id", 2, 20).cast("long") % 97 == 0).select("order_id", "month", "half", (-F.col("fee")).cast(MONEY).alias("ht"))


def platform_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What delivery invoices state: total (missing in April), collected (more in May), payout (missing in June)."""
    o = platform_orders(spark, sf_dir).groupBy("month", "half").agg(F.sum(F.when(F.col("status") == "DELIVERED", F.col("amount")).otherwise(0)).cast(MONEY).alias("collected"), F.sum("fee").cast(MONEY).alias("fees"))
    o = o.withColumns({"m": F.substring("month", 6, 2), "total": F.round(F.col("fees") * F.lit("1.20").cast("decimal(3,2)"), 2).cast(MONEY)})
    return o.select("month", "half", F.when(F.col("m") != "04", F.col("total")).alias("invoice_ttc"), F.when(F.col("m") == "05", F.col("collected") + 100).otherwise(F.col("collected")).cast(MONEY).alias("collected"), F.when(F.col("m") != "06", F.col("total") - F.col("collected")).cast(MONEY).alias("payout"))


ORDERS = """
porders AS (
  SELECT 'O' || o_orderkey AS order_id, CASE o_orderstatus WHEN 'F' THEN 'DELIVERED' WHEN 'O' THEN 'RETURNED_TO_SHOP' ELSE 'CANCELLED' END AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
    CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.12 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS fee, o_orderdate AS created_at, strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN day(o_orderdate) <= 15 THEN 'q1' ELSE 'q2' END AS half, o_orderkey AS k FROM orders),
services AS (SELECT CASE WHEN k % 31 = 0 THEN 'X' || k ELSE order_id END AS order_id, month, half, CASE WHEN k % 17 = 0 THEN CAST(fee + 1 AS DECIMAL(18,2)) ELSE fee END AS ht FROM porders WHERE k % 13 <> 0),
refunds AS (SELECT order_id, month, half, CAST(-fee AS DECIMAL(18,2)) AS ht FROM porders WHERE k % 97 = 0),
stated0 AS (SELECT month, half, CAST(sum(CASE WHEN status = 'DELIVERED' THEN amount ELSE 0 END) AS DECIMAL(18,2)) AS collected, CAST(round(CAST(sum(fee) AS DECIMAL(18,2)) * CAST(1.20 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS total, substr(month, 6, 2) AS m FROM porders GROUP BY month, half),
stated AS (SELECT month, half, CASE WHEN m <> '04' THEN total END AS invoice_ttc, CASE WHEN m = '05' THEN collected + 100 ELSE collected END AS collected, CASE WHEN m <> '06' THEN total - collected END AS payout FROM stated0)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents of dossiers out of events: invoices in archives' folders, statements and archives, some uploaded again."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    stem = F.concat(F.lit("lot"), (k % 3).cast("string"))
    name = F.when(k % 10 == 0, F.concat(stem, F.lit(".zip"))).when(k % 10 == 1, F.concat(F.lit("releve"), (k % 4).cast("string"), F.lit(".csv"))).otherwise(F.concat(stem, F.lit("/facture"), (k % 50).cast("string"), F.lit(".pdf")))
    return e.select(k.alias("id"), F.floor(F.col("user_id") / 10).alias("dossier"), F.when(k % 10 == 0, "archive").when(k % 10 == 1, "bank").otherwise("invoice").alias("kind"), name.alias("filename"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("src-"), (k % 700).cast("string"))).alias("source_id"), (k % 9 + 400).alias("size"), F.col("ts").alias("created_at"))


DOCUMENTS = """
docs AS (
  SELECT event_id AS id, user_id // 10 AS dossier, CASE event_id % 10 WHEN 0 THEN 'archive' WHEN 1 THEN 'bank' ELSE 'invoice' END AS kind,
    CASE event_id % 10 WHEN 0 THEN 'lot' || (event_id % 3) || '.zip' WHEN 1 THEN 'releve' || (event_id % 4) || '.csv' ELSE 'lot' || (event_id % 3) || '/facture' || (event_id % 50) || '.pdf' END AS filename,
    CASE WHEN event_id % 4 = 0 THEN '' ELSE 'src-' || (event_id % 700) END AS source_id, event_id % 9 + 400 AS size, ts AS created_at FROM events)"""
