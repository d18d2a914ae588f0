"""Queries of file formats and ledger storage: rows are rendered to text, read as a source would, and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.functions.lineage import cut, shared_dir
from ledgerloom.plans.bank import TXNS
from ledgerloom.plans.lines import ORACLES as LINES_SQL
from ledgerloom.plans.lines import a12_declaration_rows as declared_rows
from ledgerloom.sources import bank_files as B
from ledgerloom.sources import driver_tables as D

DECLARED_SQL = LINES_SQL["a12_declaration_rows"]


def _folder(spark) -> str:
    """A new folder in the one that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


#: Files that a period's statements are printed to, whatever their number.
FILES = 12


def _statement_files(spark, sf_dir) -> str:
    """Statements as delimited text, a bounded number of files in three layouts, some with lines above the header."""
    comma = lambda c: F.replace(c.cast("string"), F.lit("."), F.lit(","))
    label, paid = F.replace("label", F.lit(","), F.lit(" ")), F.col("amount") < 0
    p = D.payments(spark, sf_dir).withColumn("k", F.pmod("dossier", F.lit(FILES)))
    layout = F.col("k") % 3
    day, reference = F.date_format("date", "dd/MM/yyyy"), F.concat_ws("/", "dossier", "txn")
    line = (
        F.when(layout == 0, F.concat_ws(";", day, label, F.when(paid, comma(-F.col("amount"))).otherwise(""), F.when(~paid, comma(F.col("amount"))).otherwise(""), reference))
        .when(layout == 1, F.concat_ws(",", reference, F.date_format("date", "yyyy-MM-dd"), F.col("amount").cast("string"), label))
        .otherwise(F.concat_ws(";", label, comma(F.col("amount")), F.lit("MAD"), day))
    )
    heads = F.when(layout == 0, F.array(F.lit("Banque Atlas"), F.lit("Date opération;Libellé;Débit;Crédit;Référence"))).when(layout == 1, F.array(F.lit("Référence,Date valeur,Montant,Intitulé"))).otherwise(F.array(F.lit("Agence;12"), F.lit(""), F.lit("Solde;au;31"), F.lit("Motif;Montant;Devise;Date")))
    top = spark.range(FILES).select(F.col("id").alias("k")).join(p.select("k").distinct(), "k", "left_semi")
    lines = top.select("k", F.posexplode(heads).alias("ord", "value")).unionByName(p.select("k", F.lit(9).alias("ord"), line.alias("value")))
    path = _folder(spark)
    lines.repartition("k").sortWithinPartitions("k", "ord", "value").select("value", "k").write.partitionBy("k").text(path)
    return path


def _file():
    return F.regexp_extract("file", "k=(\\d+)", 1).cast("long").alias("k")


def a01_statement_files(spark, sf_dir):
    """Statement files read back as movements."""
    return B.transactions(spark, _statement_files(spark, sf_dir)).groupBy(_file(), "date", "kind").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


def a02_headers(spark, sf_dir):
    """Header row of each statement file."""
    return B.headers(B.rows(spark, _statement_files(spark, sf_dir), B.HEAD)).select(_file(), "header")


def a03_roles(spark, sf_dir):
    """Columns of each role in every statement file."""
    return B.roles(B.rows(spark, _statement_files(spark, sf_dir), B.HEAD)).select(_file(), *B.ROLES)


def a12_declaration_files(spark, sf_dir):
    """Declaration files by client and month, written twice and read back."""
    rows = cut(declared_rows(spark, sf_dir))  # written twice
    client, year, month = F.floor(F.col("dossier") / 1000), F.floor((F.col("dossier") % 1000 - 1) / 12) + 1990, (F.col("dossier") % 1000 - 1) % 12 + 1
    name = B.export_names(F.concat(F.lit("Client "), client.cast("string")), month, year)["file"]
    path = _folder(spark)
    for _ in range(2):
        B.write_declaration(rows, name, path)
    return B.read_declaration(spark, path).groupBy("file_name").agg(F.count("*").alias("n"), F.min("or_").alias("first"), F.max("or_").alias("last"), *[F.round(F.sum(c), 2).alias(c) for c in ("m_ht", "tva", "m_ttc")], F.count("date_paie").alias("paid"), F.countDistinct("ice_frs").alias("ids"), F.sum("code_tva").alias("codes"), F.round(F.sum("taux"), 1).alias("rates"))


def a16_synthetic(spark, sf_dir):
    """A made-up line for each part, every tenth without a company id: how many of them the checks find."""
    n = D.table(spark, sf_dir, "part").count()
    df = B.synthetic_lines(spark, n, 10)
    return df.groupBy((F.col("pos") % 7).alias("seventh")).agg(F.count("*").alias("n"), F.count_if(F.col("ice_frs") == "").alias("without"), F.max("fact_num").alias("last"))


def a13_export_names(spark, sf_dir):
    """Sheet and file of every period's declaration."""
    o = D.table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 300).alias("client"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).distinct()
    return o.select("client", "year", "month", B.export_names(F.concat(F.lit("Café & Fils n°"), F.col("client").cast("string")), F.col("month"), F.col("year")).alias("x")).select("client", "year", "month", "x.*")


def a14_activity(spark, sf_dir):
    """The activity log after two appends, entries by dossier and type."""
    e = D.table(spark, sf_dir, "events").select(F.col("user_id").alias("dossier"), "event_id", "event_type")
    path = _folder(spark)
    B.append_activity(e.where("event_id % 2 = 0"), path)
    B.append_activity(e.where("event_id % 2 = 1"), path)
    return spark.read.schema(e.schema).json(path).groupBy("dossier", "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


def a05_json_movements(spark, sf_dir):
    """Movements given as JSON arrays."""
    p = D.payments(spark, sf_dir)
    item = F.struct(F.col("date").cast("string").alias("date"), F.col("label").alias("libelle"), F.abs("amount").cast("string").alias("montant"), F.when(F.col("amount") < 0, "debit").otherwise("credit").alias("type"))
    raw = p.groupBy(F.col("dossier").alias("doc")).agg(F.to_json(F.array_sort(F.collect_list(item))).alias("json"))
    return B.normalise_json(raw).select("doc", "date", "label", "amount", "kind")


def a06_platform_orders(spark, sf_dir):
    """Orders of the platform's export."""
    return D.platform_orders(spark, sf_dir).select("order_id", "status", F.col("amount").cast("double").alias("amount"), F.col("fee").cast("double").alias("fee"), "half")


def _ledger(spark, sf_dir):
    return D.invoice_lines(spark, sf_dir).select("dossier", "pos", "fact_num", F.col("ttc").cast("string").alias("ttc"), F.col("pct").cast("string").alias("taux"))


def a09_ledger_json(spark, sf_dir):
    """Ledgers stored as JSON and read as rows."""
    return B.explode_ledger(B.collect_ledger(_ledger(spark, sf_dir))).select("dossier", "at", "pos", "fact_num", F.col("ttc").cast("double").alias("ttc"))


def a10_upsert_ledgers(spark, sf_dir):
    """Ledgers after replacing those of even dossiers by their first lines."""
    lines = _ledger(spark, sf_dir)
    merged = B.upsert_ledgers(B.collect_ledger(lines), B.collect_ledger(lines.where("dossier % 2 = 0 and pos % 1000 = 1")))
    return B.explode_ledger(merged).groupBy("dossier").agg(F.count("*").alias("n"))


def a11_parse_lines(spark, sf_dir):
    """Extracted JSON lines with errors kept."""
    lines = D.invoice_lines(spark, sf_dir)
    item = F.struct("pos", "fact_num", F.when(F.col("pos") % 41 == 0, "illisible").otherwise(F.col("ht").cast("string")).alias("m_ht"), F.col("tva").cast("string").alias("tva"), F.when(F.col("pos") % 7 == 0, "33").otherwise(F.col("pct").cast("string")).alias("taux"))
    raw = lines.groupBy(F.col("dossier").alias("doc")).agg(F.to_json(F.array_sort(F.collect_list(item))).alias("json"))
    return B.parse_lines(raw).select("doc", (F.col("pos") + 1).cast("long").alias("pos"), "ht", "pct", "warning")


def a15_reference(spark, sf_dir):
    """Lines by VAT code through the reference dimensions."""
    from ledgerloom.functions.scalars import VAT_CODES

    codes = spark.createDataFrame([(d, p, c) for (d, p), c in VAT_CODES.items()], "designation string, pct int, code int")
    return D.invoice_lines(spark, sf_dir).join(F.broadcast(codes), ["designation", "pct"]).groupBy("code").agg(F.count("*").alias("n"))


def a17_payload(spark, sf_dir):
    """Bytes of each stored ledger, with its movements, against those of its summary."""
    lines = _ledger(spark, sf_dir)
    bank = D.payments(spark, sf_dir).groupBy("dossier").agg(F.to_json(F.array_sort(F.collect_list(F.struct("txn", F.col("amount").cast("string").alias("amount"))))).alias("bank"))
    ledgers = B.collect_ledger(lines).join(bank, "dossier", "left").withColumn("bank", F.coalesce("bank", F.lit("[]")))
    summaries = lines.groupBy("dossier").agg(F.count("*").alias("lines")).join(D.payments(spark, sf_dir).groupBy("dossier").agg(F.count("*").alias("bank")), "dossier", "left").withColumn("bank", F.coalesce("bank", F.lit(0)))
    return B.payload_bytes(ledgers, summaries)


def a18_newest_statement(spark, sf_dir):
    """Movements that stay when the newest statement of each dossier replaces the others."""
    p = D.payments(spark, sf_dir).withColumn("file", F.date_format("date", "yyyy-MM"))
    newest = p.groupBy("dossier").agg(F.max("file").alias("file"))
    return p.join(newest, ["dossier", "file"]).groupBy("dossier", "file").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))


QUERIES = {f.__name__: f for f in (a01_statement_files, a02_headers, a03_roles, a12_declaration_files, a13_export_names, a14_activity, a05_json_movements, a06_platform_orders, a09_ledger_json, a10_upsert_ledgers, a11_parse_lines, a15_reference, a16_synthetic, a17_payload, a18_newest_statement)}
ORACLES = {
    "a02_headers": f"WITH {D.LINES}, {D.PAYMENTS} SELECT DISTINCT dossier % {FILES} AS k, CAST(CASE (dossier % {FILES}) % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 3 END AS INTEGER) AS header FROM payments",
    "a03_roles": f"WITH {D.LINES}, {D.PAYMENTS}, f AS (SELECT DISTINCT dossier % {FILES} AS k, dossier % {FILES} % 3 AS l FROM payments) SELECT k, CAST(CASE l WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END AS INTEGER) AS date, CAST(CASE l WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 0 END AS INTEGER) AS label, CAST(CASE WHEN l = 0 THEN 2 END AS INTEGER) AS debit, CAST(CASE WHEN l = 0 THEN 3 END AS INTEGER) AS credit, CAST(CASE l WHEN 1 THEN 2 WHEN 2 THEN 1 END AS INTEGER) AS amount FROM f",
    "a12_declaration_files": f"WITH r AS ({DECLARED_SQL}), d AS (SELECT *, dossier // 1000 AS c, dossier % 1000 - 1 AS m FROM r) SELECT 'Client_' || c || '_DED_TVA_' || lpad(CAST(m % 12 + 1 AS VARCHAR), 2, '0') || (m // 12 + 1990) AS file_name, count(*) AS n, min(or_) AS first, max(or_) AS last, round(sum(m_ht), 2) AS m_ht, round(sum(tva), 2) AS tva, round(sum(m_ttc), 2) AS m_ttc, count(date_paie) AS paid, count(DISTINCT nullif(ice_frs, '')) AS ids, CAST(sum(code_tva) AS BIGINT) AS codes, round(sum(taux), 1) AS rates FROM d GROUP BY ALL",
    "a16_synthetic": "SELECT i % 7 AS seventh, count(*) AS n, count(*) FILTER (i % 10 = 0) AS without, max('F' || i) AS last FROM (SELECT unnest(range(1, (SELECT count(*) FROM part) + 1)) AS i) GROUP BY 1",
    "a13_export_names": "SELECT DISTINCT o_custkey // 300 AS client, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, 'EDI' || strftime(o_orderdate, '%m%y') AS sheet, 'Café___Fils_n_' || (o_custkey // 300) || '_DED_TVA_' || strftime(o_orderdate, '%m%Y') AS file FROM orders",
    "a14_activity": "SELECT user_id AS dossier, event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY ALL",
    "a01_statement_files": f"WITH {TXNS} SELECT dossier % {FILES} AS k, strftime(date, '%Y-%m-%d') AS date, kind, count(*) AS n, CAST(round(sum(amount), 2) AS DOUBLE) AS amount FROM txns GROUP BY ALL",
    "a05_json_movements": f"WITH {TXNS} SELECT dossier AS doc, CAST(date AS VARCHAR) AS date, label, CAST(amount AS DOUBLE) AS amount, kind FROM txns",
    "a06_platform_orders": f"WITH {D.ORDERS} SELECT order_id, status, CAST(amount AS DOUBLE) AS amount, CAST(fee AS DOUBLE) AS fee, half FROM porders",
    "a09_ledger_json": f"WITH {D.LINES} SELECT dossier, CAST(row_number() OVER (PARTITION BY dossier ORDER BY pos) - 1 AS INTEGER) AS at, pos, fact_num, CAST(ttc AS DOUBLE) AS ttc FROM lines".replace(" AS at,", ' AS "at",'),
    "a10_upsert_ledgers": f"WITH {D.LINES} SELECT dossier, CASE WHEN dossier % 2 = 0 AND count(*) FILTER (pos % 1000 = 1) > 0 THEN count(*) FILTER (pos % 1000 = 1) ELSE count(*) END AS n FROM lines GROUP BY dossier",
    "a11_parse_lines": f"WITH {D.LINES}, x AS (SELECT *, CASE WHEN pos % 41 = 0 THEN NULL ELSE ht END AS h FROM lines) SELECT dossier AS doc, row_number() OVER (PARTITION BY dossier ORDER BY pos) AS pos, CAST(h AS DOUBLE) AS ht, CASE WHEN pos % 7 <> 0 THEN pct WHEN h IS NULL OR abs(h) < 0.01 THEN 20 WHEN abs(tva) < 0.05 THEN 0 WHEN abs(tva) BETWEEN abs(h) * 0.075 AND abs(h) * 0.125 THEN 10 ELSE 20 END AS pct, CASE WHEN h IS NULL THEN 'unreadable amount' ELSE '' END AS warning FROM x",
    "a15_reference": f"WITH {D.LINES}, codes(d, p, code) AS (VALUES ('MATIERES CONSOMMABLES', 20, 146), ('MATIERES CONSOMMABLES', 10, 150), ('PRESTATIONS', 20, 140), ('TELEPHONIE', 20, 140), ('FRAIS BANCAIRE', 10, 142)) SELECT code, count(*) AS n FROM lines JOIN codes ON d = designation AND p = pct GROUP BY code",
    "a17_payload": f"WITH {D.LINES}, {D.PAYMENTS}, j AS (SELECT dossier, count(*) AS n, '[' || string_agg('{{{{\"pos\":' || pos || ',\"fact_num\":\"' || fact_num || '\",\"ttc\":\"' || CAST(ttc AS VARCHAR) || '\",\"taux\":\"' || pct || '\"}}}}', ',' ORDER BY pos) || ']' AS x FROM lines GROUP BY dossier), b AS (SELECT dossier, count(*) AS nb, '[' || string_agg('{{{{\"txn\":\"' || txn || '\",\"amount\":\"' || CAST(amount AS VARCHAR) || '\"}}}}', ',' ORDER BY txn) || ']' AS y FROM payments GROUP BY dossier), z AS (SELECT dossier, CAST(strlen('{{{{\"dossier\":' || dossier || ',\"lines\":\"' || replace(x, '\"', '\\\"') || '\",\"bank\":\"' || replace(coalesce(y, '[]'), '\"', '\\\"') || '\"}}}}') AS INTEGER) AS payload_bytes, CAST(strlen('{{{{\"dossier\":' || dossier || ',\"lines\":' || n || ',\"bank\":' || coalesce(nb, 0) || '}}}}') AS INTEGER) AS summary_bytes FROM j LEFT JOIN b USING (dossier)) SELECT *, round(payload_bytes / summary_bytes, 2) AS ratio FROM z".replace("{{", "{").replace("}}", "}"),
    "a18_newest_statement": f"WITH {TXNS}, f AS (SELECT *, strftime(date, '%Y-%m') AS file FROM payments) SELECT dossier, file, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM f WHERE file = (SELECT max(file) FROM f g WHERE g.dossier = f.dossier) GROUP BY dossier, file",
}
