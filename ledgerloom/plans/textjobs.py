"""Queries that render documents from ledger rows and extract them again; the twins know what was rendered."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import textjobs as T
from ledgerloom.sources import driver_tables as D


def comma(c):
    return F.replace(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("."), F.lit(","))


def invoices(spark, sf_dir, lines=None):
    """One text per invoice, of all its lines (those given, if any), amounts without signs: header, rate rows, footer."""
    lines = D.invoice_lines(spark, sf_dir) if lines is None else lines
    per = lines.groupBy("dossier", "fact_num", "pct").agg(F.abs(F.sum("ht")).cast("decimal(18,2)").alias("ht"), F.abs(F.sum("tva")).cast("decimal(18,2)").alias("tva"), F.max("date_fac").alias("day"), F.max("ice_frs").alias("ice"), F.max("if_number").alias("fiscal"), F.min("lib_frss").alias("name"))
    per = per.withColumn("ttc", (F.col("ht") + F.col("tva")).cast("decimal(18,2)")).repartition("dossier", "fact_num")  # as numbers; what is printed of them is longer
    line = F.concat_ws(" ", F.concat(comma("ttc"), F.lit("TTC")), F.concat(F.col("pct").cast("string"), F.lit(",00%")), comma("tva"))
    table = F.concat_ws(" ", F.concat(F.col("pct").cast("string"), F.lit(",00")), comma("ht"), comma("tva"))
    table = F.when(F.col("pct") == 0, F.concat_ws(" ", F.lit("0,00"), comma("ht"), comma("tva"))).otherwise(table)
    agg = per.groupBy("dossier", "fact_num").agg(
        F.sum("ht").cast("decimal(18,2)").alias("ht"), F.sum("tva").cast("decimal(18,2)").alias("tva"), F.sum("ttc").cast("decimal(18,2)").alias("ttc"), F.max("day").alias("day"), F.max("ice").alias("ice"), F.max("fiscal").alias("fiscal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pct", line.alias("x")))), lambda r: r["x"]), "\n").alias("rows"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pct", table.alias("x")))), lambda r: r["x"]), "\n").alias("table"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pct", F.concat_ws("\n", F.concat(F.lit("Poste "), F.col("pct").cast("string")), comma("ht"), comma("tva"), comma("ttc")).alias("x")))), lambda r: r["x"]), "\n").alias("details"),
    )
    head = F.concat(F.lit("ATLAS DISTRIB SARL\nClient Dupont\nFACTURE N° "), F.col("fact_num"), F.lit("\nDate : "), F.date_format("day", "dd/MM/yyyy"), F.lit("\nRéférence : FACTURE N° REF999\n"))
    foot = F.concat(F.lit("\nTotal HT : "), comma("ht"), F.lit(" DH\nTotal TVA : "), comma("tva"), F.lit("\nTotal TTC : "), comma("ttc"), F.lit("\nCapital 100 000 RC : 4567 Patente : 7654321 ICE : "), F.when(F.col("ice") == "", "000000000000777").otherwise(F.col("ice")), F.lit(" I.F : "), F.when(F.col("fiscal") == "", "40000777").otherwise(F.col("fiscal")))
    k = F.substring("fact_num", -1, 1).cast("int") % 2
    return agg.select("dossier", "fact_num", F.concat("dossier", F.lit("/"), "fact_num").alias("doc"), F.concat(F.lit("x/"), "fact_num", F.lit(".pdf")).alias("filename"), F.concat(head, F.when(k == 0, F.col("rows")).otherwise(F.concat(F.lit("Taux Montant HT TVA\n"), "table")), foot).alias("text"), F.concat(head, F.col("details"), foot).alias("detailed"), F.lit("Dupont").alias("client"), F.lit("000000000000001").alias("client_ice"))


def printed(spark, sf_dir):
    """One text per invoice, of all its lines: five ways to print its number and six to print its amounts, with totals that contradict the rows now and then.

    Amounts are printed without signs; credit notes cite the invoice they take back.
    """
    money = "decimal(18,2)"
    per = D.invoice_lines(spark, sf_dir).groupBy("dossier", "fact_num", "pct").agg(*[F.abs(F.sum(c)).cast(money).alias(c) for c in ("ht", "tva")], F.max("date_fac").alias("day"), F.max("ice_frs").alias("ice"), F.max("if_number").alias("fiscal"))
    per = per.withColumn("ttc", (F.col("ht") + F.col("tva")).cast(money))
    rows = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pct", x.alias("x")))), lambda r: r["x"]), "\n")
    rate = F.concat(F.col("pct").cast("string"), F.lit(",00"))
    agg = per.groupBy("dossier", "fact_num").agg(
        *[F.sum(c).cast(money).alias(c) for c in ("ht", "tva", "ttc")], F.max("day").alias("day"), F.max("ice").alias("ice"), F.max("fiscal").alias("fiscal"),
        rows(F.concat_ws(" ", F.concat(comma("ttc"), F.lit("TTC")), F.concat(rate, F.lit("%")), comma("tva"))).alias("rated"), rows(F.concat_ws(" ", rate, comma("ht"), comma("tva"))).alias("table"),
        rows(F.concat_ws("\n", F.concat(F.lit("Poste "), F.col("pct").cast("string")), comma("ht"), comma("tva"), comma("ttc"))).alias("details"),
    )
    k = F.regexp_extract("fact_num", r"(\d+)", 1).cast("long")
    credit, t, b = F.col("fact_num").startswith("AVOIR"), k % 5, F.floor(k / 5) % 5
    cites = F.lit("\nRéférence : FACTURE N° REF999\n")
    number = (
        F.when(credit, F.concat(F.lit("AVOIR N° "), F.lpad(k.cast("string"), 9, "0"))).when(t == 0, F.concat(F.lit("FACTURE N° "), "fact_num")).when(t == 1, F.concat(F.lit("Facture Vente\nN° : "), "fact_num"))
        .when(t == 2, F.concat(F.lit("Pièce jointe FV"), F.lpad(k.cast("string"), 9, "0"))).when(t == 3, "Ticket de caisse").otherwise(F.concat(F.lit("N° Pièce : "), "fact_num"))
    )
    head = F.concat(F.lit("STE ATLAS "), (k % 97).cast("string"), F.lit(" SARL\nClient Dupont\n"), number, cites, F.lit("Date : "), F.date_format("day", "dd/MM/yyyy"), F.lit("\n"))
    times = F.when(k % 7 == 0, 2).otherwise(1)
    total = lambda c: comma((F.col(c) * times).cast(money))
    totals = F.concat(F.lit("\nTotal HT : "), total("ht"), F.lit(" DH\nTotal TVA : "), total("tva"), F.lit("\nTotal TTC : "), total("ttc"))
    body = (
        F.when(credit, F.concat_ws("\n", F.lit("Net à payer"), *[F.concat(comma(c), F.lit(" DH")) for c in ("ttc", "tva", "ht")], F.lit("ARRETEE la présente somme")))
        .when(b == 0, F.concat("rated", totals)).when(b == 1, F.concat(F.lit("Taux Montant HT TVA\n"), "table", totals)).when(b == 2, F.concat("details", totals)).when(b == 3, totals)
        .otherwise(F.concat_ws("\n", F.lit("Ticket"), *[F.concat(comma(c), F.lit(" MAD")) for c in ("ttc", "ht", "tva")]))
    )
    foot = F.concat(F.lit("\nCapital 100 000 RC : "), (k % 900 + 1000).cast("string"), F.lit(" Patente : "), (k % 9000 + 7000000).cast("string"), F.lit(" ICE : "), F.when(F.col("ice") == "", "000000000000777").otherwise(F.col("ice")), F.lit(" I.F : "), F.when(F.col("fiscal") == "", "40000777").otherwise(F.col("fiscal")))
    return agg.select("dossier", "fact_num", F.concat("dossier", F.lit("/"), "fact_num").alias("doc"), F.concat(F.lit("x/"), "fact_num", F.lit(".pdf")).alias("filename"), F.concat(head, body, foot).alias("text"), F.lit("Dupont").alias("client"), F.lit("000000000000001").alias("client_ice"))


#: Twin of :func:`printed`: rows of each rate, invoices, the layouts they are printed in and the number they are read with.
PRINTED = f"""{D.LINES}, per AS (SELECT *, CAST(ht + tva AS DECIMAL(18,2)) AS ttc FROM (SELECT dossier, fact_num, pct, CAST(abs(sum(ht)) AS DECIMAL(18,2)) AS ht, CAST(abs(sum(tva)) AS DECIMAL(18,2)) AS tva, max(date_fac) AS day, max(ice_frs) AS ice, max(if_number) AS fiscal FROM lines GROUP BY ALL)),
inv AS (SELECT *, fact_num LIKE 'AVOIR%' AS credit, k % 5 AS t, (k // 5) % 5 AS b, CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END AS times, 'STE ATLAS ' || (k % 97) || ' SARL' AS name, (k % 900 + 1000) || ',' || (k % 9000 + 7000000) AS others
  FROM (SELECT dossier, fact_num, sum(ht) AS ht, sum(tva) AS tva, sum(ttc) AS ttc, max(day) AS day, CASE WHEN max(ice) = '' THEN '000000000000777' ELSE max(ice) END AS ice, CASE WHEN max(fiscal) = '' THEN '40000777' ELSE max(fiscal) END AS fiscal, CAST(regexp_extract(fact_num, '[0-9]+') AS BIGINT) AS k FROM per GROUP BY ALL)),
docs AS (SELECT *, CASE WHEN credit THEN lpad(CAST(k AS VARCHAR), 9, '0') WHEN t = 2 THEN 'FV' || lpad(CAST(k AS VARCHAR), 9, '0') ELSE fact_num END AS number, CASE WHEN credit THEN lpad(CAST(k AS VARCHAR), 9, '0') WHEN t IN (0, 4) AND length(fact_num) > 2 THEN fact_num END AS own FROM inv)"""

INV = f"{D.LINES}, per0 AS (SELECT dossier, fact_num, pct, CAST(abs(sum(ht)) AS DECIMAL(18,2)) AS ht, CAST(abs(sum(tva)) AS DECIMAL(18,2)) AS tva, max(date_fac) AS day, max(ice_frs) AS ice, max(if_number) AS fiscal FROM lines GROUP BY ALL), per AS (SELECT *, CAST(ht + tva AS DECIMAL(18,2)) AS ttc, CAST(right(fact_num, 1) AS INTEGER) % 2 AS odd FROM per0), inv AS (SELECT dossier, fact_num, sum(ht) AS ht, sum(tva) AS tva, sum(ttc) AS ttc, max(day) AS day, CASE WHEN max(ice) = '' THEN '000000000000777' ELSE max(ice) END AS ice, CASE WHEN max(fiscal) = '' THEN '40000777' ELSE max(fiscal) END AS fiscal, count(*) AS n FROM per GROUP BY ALL)"
#: Bundled documents, each with the number it opens with, if any.
BUNDLES = "bundles AS (SELECT dossier || ':' || (k % 7) AS doc, fact_num, own FROM docs)"
#: Rows of the rate table that make sense by their ratio.
SENSE = "((ht >= 0.01 OR tva >= 0.01) AND (ht = 0 OR tva < 0.05 OR tva BETWEEN ht * 0.08 AND ht * 0.12 OR tva BETWEEN ht * 0.18 AND ht * 0.22))"


def d01_ventilation(spark, sf_dir):
    """Rate rows printed as TTC with a rate."""
    return T.ventilation(invoices(spark, sf_dir), ["dossier", "fact_num"])


def d02_rate_table(spark, sf_dir):
    """Rate rows of tables."""
    return T.rate_table(invoices(spark, sf_dir), ["dossier", "fact_num"])


def d03_best_rows(spark, sf_dir):
    """Better rate rows of each document."""
    return T.best_rows(invoices(spark, sf_dir), ["dossier", "fact_num"])


def _field(called, **fields):
    def query(spark, sf_dir):
        return printed(spark, sf_dir).select("dossier", "fact_num", *[f(F.col("text")).alias(k) for k, f in fields.items()])

    query.__name__ = called
    return query


def d08_detail_rows(spark, sf_dir):
    """Detail rows of documents."""
    return T.one_a_line(invoices(spark, sf_dir), ["dossier", "fact_num"], T.detail_rows(F.col("detailed")), "label")


def d09_details_match(spark, sf_dir):
    """Whether detail rows sum up to the footer."""
    d = T.with_footer(invoices(spark, sf_dir), "detailed").withColumns({"t": T.document_totals(F.col("footer")), "rows": T.detail_rows(F.col("detailed"))})
    return d.select("dossier", "fact_num", T.details_match(F.col("rows"), F.col("t")).alias("match"))


def d04_footer(spark, sf_dir):
    """Totals of each document's footer."""
    return T.with_footer(invoices(spark, sf_dir)).select("dossier", "fact_num", "footer.*")


def d05_document_totals(spark, sf_dir):
    """Coherent totals of each document."""
    return T.with_footer(invoices(spark, sf_dir)).select("dossier", "fact_num", T.document_totals(F.col("footer"))["ttc"].alias("ttc"))


def d06_credit_totals(spark, sf_dir):
    """Totals of credit notes rendered from the invoices."""
    i = T.with_footer(invoices(spark, sf_dir), into="f")
    c = lambda x: F.format_string("%.2f", F.col(f"f.{x}"))
    text = F.concat(F.lit("AVOIR N° A1\nNet à payer\n"), F.replace(c("ttc"), F.lit("."), F.lit(",")), F.lit(" DH\n"), F.replace(c("tva"), F.lit("."), F.lit(",")), F.lit(" DH\n"), F.replace(c("ht"), F.lit("."), F.lit(",")), F.lit("\nARRETEE la présente"))
    return i.select("dossier", "fact_num", text.alias("text")).select("dossier", "fact_num", T.credit_totals(F.col("text")).alias("t")).select("dossier", "fact_num", "t.*")


def d07_currency_totals(spark, sf_dir):
    """Amounts in currency rendered from the invoices."""
    i = T.with_footer(invoices(spark, sf_dir), into="f")
    c = lambda x: F.concat(F.format_string("%.2f", F.col(f"f.{x}")), F.lit("MAD\n"))
    return i.select("dossier", "fact_num", T.currency_totals(F.concat(F.lit("Ticket\n"), c("ttc"), c("ht"), c("tva"))).alias("t")).select("dossier", "fact_num", "t.*")


def _bundles(spark, sf_dir):
    """Up to a hundred invoices of a dossier in one text."""
    i = printed(spark, sf_dir).withColumn("doc", F.concat_ws(":", "dossier", (F.regexp_extract("fact_num", r"(\d+)", 1).cast("long") % 7).cast("string")))
    return i.select("doc", "fact_num", "text")


def d14_segments(spark, sf_dir):
    """Bundled texts split at each new number."""
    b = _bundles(spark, sf_dir).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fact_num", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return T.segments(b).groupBy("doc").agg(F.count("*").cast("long").alias("segments"), F.array_join(F.array_sort(F.collect_list("number")), ",").alias("numbers"))


def d15_page_groups(spark, sf_dir):
    """Pages grouped under their number: each invoice is followed by a page without one."""
    from pyspark.sql import Window

    p = _bundles(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy("fact_num")))
    pages = p.select("doc", F.explode(F.array(F.struct((F.col("k") * 2).alias("page"), "text"), F.struct((F.col("k") * 2 + 1).alias("page"), F.lit("suite sans titre").alias("text")))).alias("x")).select("doc", "x.*")
    return T.page_groups(pages).select("doc", "number", "pages")


def d16_extract(spark, sf_dir):
    """Lines extracted from whole documents."""
    return T.extract(printed(spark, sf_dir).drop("fact_num", "dossier"))


def d17_delivery(spark, sf_dir):
    """Delivery invoices rendered from the services of each half-month, and read again."""
    s = D.platform_services(spark, sf_dir)
    row = F.concat_ws(" ", F.lit("Serv. On Demand"), "order_id", F.concat("month", F.lit("-01")), F.lit("1"), F.col("ht").cast("string"), F.lit("20"), F.round(F.col("ht") * F.lit("0.20").cast("decimal(3,2)"), 2).cast("decimal(18,2)").cast("string"), F.round(F.col("ht") * F.lit("1.20").cast("decimal(3,2)"), 2).cast("decimal(18,2)").cast("string"), F.lit("MAD"))
    # invoices of a bounded number of services each: their number grows with the table, not their length
    several = F.pmod(F.xxhash64("order_id"), F.lit(max(1, s.count() // 100_000)))
    t = s.groupBy("month", "half", several.alias("invoice")).agg(F.concat(F.lit("MA-FVR1 "), F.array_join(F.collect_list(row), " "), F.lit(" Total de la facture (TTC) "), F.sum("ht").cast("string"), F.lit(" MAD Montant collecté 1,000.50 MAD Montant à payer au partenaire -12.00 MAD")).alias("text"))
    rows = T.delivery_services(t, ["month", "half"]).groupBy("month", "half").agg(F.count("*").alias("services"), F.round(F.sum("ht"), 2).alias("ht"))
    x = t.select("month", "half", T.delivery_summary(F.col("text")).alias("x")).groupBy("month", "half").agg(F.min("x.number").alias("number"), F.round(F.sum("x.ttc"), 2).alias("ttc"), F.max("x.collected").alias("collected"), F.max("x.payout").alias("payout"))
    return rows.join(x, ["month", "half"])


def _statements(spark, sf_dir):
    p = D.payments(spark, sf_dir)
    row = F.concat_ws(" : ", "label", F.date_format("date", "dd/MM/yyyy"), F.replace(F.col("amount").cast("string"), F.lit("."), F.lit(",")))
    return p.groupBy(F.col("dossier").alias("doc")).agg(F.concat(F.lit("ATTIJARI BANK\nICE : 000111222333444 RC : 333 IF : 1084612\nSolde initial 01/01/2024 100,00\n"), F.array_join(F.array_sort(F.collect_list(row)), "\n")).alias("text"))


def d18_bank_identity(spark, sf_dir):
    """Bank of each statement."""
    return _statements(spark, sf_dir).select("doc", T.bank_identity(F.col("text")).alias("b")).select("doc", "b.*")


def d19_bank_rows(spark, sf_dir):
    """Movements of each statement."""
    return T.bank_rows(_statements(spark, sf_dir)).select("doc", "date", "amount")


QUERIES = {
    "d10_invoice_number": _field("d10", number=lambda t: T.invoice_number(t, F.col("filename"))),
    "d11_supplier_name": _field("d11", name=lambda t: T.supplier_name(t, F.col("client"))),
    "d12_supplier_ice": _field("d12", ice=lambda t: T.supplier_ice(t, F.col("client_ice"))),
    "d13_supplier_if": _field("d13", fiscal=T.supplier_if, others=lambda t: F.array_join(F.array_sort(T.other_ids(t)), ",")),
} | {f.__name__: f for f in (d01_ventilation, d02_rate_table, d03_best_rows, d04_footer, d05_document_totals, d06_credit_totals, d07_currency_totals, d08_detail_rows, d09_details_match, d14_segments, d15_page_groups, d16_extract, d17_delivery, d18_bank_identity, d19_bank_rows)}

VALUES = "CAST({0}ht AS DOUBLE) AS ht, CAST({0}tva AS DOUBLE) AS tva, CAST({0}ttc AS DOUBLE) AS ttc"
ALL = VALUES.format("")
ORACLES = {
    "d01_ventilation": f"WITH {INV} SELECT dossier, fact_num, pct, {ALL} FROM per WHERE odd = 0",
    "d02_rate_table": f"WITH {INV} SELECT dossier, fact_num, pct, {ALL} FROM per WHERE odd = 1 AND {SENSE}",
    "d03_best_rows": f"WITH {INV} SELECT dossier, fact_num, pct, {ALL} FROM per WHERE odd = 0 OR {SENSE}",
    "d04_footer": f"WITH {INV} SELECT dossier, fact_num, {ALL} FROM inv",
    "d05_document_totals": f"WITH {INV} SELECT dossier, fact_num, CAST(CASE WHEN ht > 0 AND ttc > 0 THEN ttc END AS DOUBLE) AS ttc FROM inv",
    "d06_credit_totals": f"WITH {INV}, s AS (SELECT dossier, fact_num, list_sort(list_distinct([x FOR x IN [ht, tva, ttc] IF x > 0])) AS o FROM inv) SELECT dossier, fact_num, CAST(CASE WHEN len(o) > 2 THEN -o[2] END AS DOUBLE) AS ht, CAST(CASE WHEN len(o) > 2 THEN -o[1] END AS DOUBLE) AS tva, CAST(CASE WHEN len(o) > 2 THEN -o[3] END AS DOUBLE) AS ttc FROM s",
    "d07_currency_totals": f"WITH {INV}, s AS (SELECT dossier, fact_num, list_sort([x FOR x IN [ht, tva, ttc] IF x > 0]) AS o FROM inv) SELECT dossier, fact_num, CAST(CASE WHEN len(o) > 2 THEN o[2] END AS DOUBLE) AS ht, CAST(CASE WHEN len(o) > 2 THEN o[1] END AS DOUBLE) AS tva, CAST(CASE WHEN len(o) > 2 THEN o[3] END AS DOUBLE) AS ttc FROM s",
    "d08_detail_rows": f"WITH {INV} SELECT dossier, fact_num, 'Poste ' || pct AS label, {ALL} FROM per",
    "d09_details_match": f"WITH {INV} SELECT dossier, fact_num, bool_and(ht > 0 AND ttc > 0) AS match FROM per GROUP BY ALL",
    "d10_invoice_number": f"WITH {PRINTED} SELECT dossier, fact_num, number FROM docs",
    "d11_supplier_name": f"WITH {PRINTED} SELECT dossier, fact_num, name FROM docs",
    "d12_supplier_ice": f"WITH {PRINTED} SELECT dossier, fact_num, CASE WHEN ice = '000000000000001' THEN '' ELSE ice END AS ice FROM docs",
    "d13_supplier_if": f"WITH {PRINTED} SELECT dossier, fact_num, fiscal, others FROM docs",
    # texts that open with no number belong to what stands before them
    "d14_segments": f"WITH {PRINTED}, {BUNDLES} SELECT doc, greatest(count(own), 1) AS segments, coalesce(string_agg(own, ',' ORDER BY own), '') AS numbers FROM bundles GROUP BY doc",
    "d15_page_groups": f"WITH {PRINTED}, {BUNDLES}, n AS (SELECT doc, last_value(own IGNORE NULLS) OVER (PARTITION BY doc ORDER BY fact_num) AS number FROM bundles) SELECT doc, number, 2 * count(*) AS pages FROM n GROUP BY doc, number",
    "d16_extract": f"""WITH {PRINTED}, good AS (SELECT per.*, row_number() OVER (PARTITION BY dossier, fact_num ORDER BY pct) AS n FROM per JOIN docs USING (dossier, fact_num) WHERE NOT credit AND (b = 0 OR (b = 1 AND {SENSE.replace('tva', 'per.tva').replace('ht ', 'per.ht ')}))),
test AS (SELECT d.*, credit OR b = 4 AS free, coalesce(g.n, 0) AS rated, abs(coalesce(g.ht, 0) - d.ht * times) <= greatest(0.05, d.ht * times * 0.01) AS agree, b = 2 AND NOT credit AS listed, coalesce(p.sound, false) AND abs(d.ht - d.ht * times) <= greatest(0.05, d.ht * times * 0.01) AS matching, d.ht * times > 0 AND d.ttc * times > 0 AS whole
  FROM docs d LEFT JOIN (SELECT dossier, fact_num, count(*) AS n, sum(ht) AS ht FROM good GROUP BY ALL) g ON g.dossier = d.dossier AND g.fact_num = d.fact_num LEFT JOIN (SELECT dossier, fact_num, bool_and(ht > 0 AND ttc > 0) AS sound FROM per GROUP BY ALL) p ON p.dossier = d.dossier AND p.fact_num = d.fact_num),
picked AS (SELECT *, CASE WHEN free THEN 'single' WHEN rated > 0 AND (NOT whole OR agree) THEN 'rated' WHEN listed AND (NOT whole OR matching) THEN 'listed' ELSE 'single' END AS source, list_sort([x FOR x IN [ht, tva, ttc] IF x > 0]) AS mad, list_sort(list_distinct([x FOR x IN [ht, tva, ttc] IF x > 0])) AS net FROM test),
rows AS (SELECT dossier, fact_num, pct, per.ht, per.tva, per.ttc, '' AS warning FROM good per JOIN (SELECT dossier, fact_num FROM picked WHERE source = 'rated') USING (dossier, fact_num)
  UNION ALL SELECT dossier, fact_num, NULL, per.ht, per.tva, per.ttc, '' FROM per JOIN (SELECT dossier, fact_num FROM picked WHERE source = 'listed') USING (dossier, fact_num)
  UNION ALL SELECT dossier, fact_num, NULL, CASE WHEN credit THEN coalesce(-net[2] * CAST(len(net) > 2 AS INTEGER), 0) WHEN b = 4 THEN CASE WHEN len(mad) > 2 THEN mad[2] ELSE 0 END ELSE ht * times END,
    CASE WHEN credit THEN coalesce(-net[1] * CAST(len(net) > 2 AS INTEGER), 0) WHEN b = 4 THEN CASE WHEN len(mad) > 2 THEN mad[1] ELSE 0 END ELSE tva * times END,
    CASE WHEN credit THEN CASE WHEN ttc = 0 AND len(net) > 2 THEN -net[3] ELSE ttc END WHEN b = 4 THEN CASE WHEN len(mad) > 2 THEN mad[3] ELSE 0 END ELSE ttc * times END,
    CASE WHEN (credit AND len(net) < 3) OR (NOT credit AND b = 4 AND len(mad) < 3) THEN 'amounts not found' WHEN credit THEN 'credit note' ELSE '' END FROM picked WHERE source = 'single')
SELECT docs.dossier || '/' || docs.fact_num AS doc, number AS fact_num, name AS lib_frss, CASE WHEN ice = '000000000000001' THEN '' ELSE ice END AS ice_frs, fiscal AS if_number, CAST(day AS VARCHAR) AS date_fac, 'MATIERES CONSOMMABLES' AS designation, warning,
  CAST(CASE WHEN rows.pct IS NOT NULL THEN rows.pct WHEN abs(rows.ht) < 0.01 THEN 20 WHEN abs(rows.tva) < 0.05 THEN 0 WHEN abs(rows.tva) BETWEEN abs(rows.ht) * 0.075 AND abs(rows.ht) * 0.125 THEN 10 ELSE 20 END AS INTEGER) AS pct, CAST(rows.ht AS DOUBLE) AS ht, CAST(rows.tva AS DOUBLE) AS tva, CAST(rows.ttc AS DOUBLE) AS ttc
FROM rows JOIN docs ON docs.dossier = rows.dossier AND docs.fact_num = rows.fact_num""",
    "d17_delivery": f"WITH {D.ORDERS} SELECT month, half, count(*) AS services, CAST(sum(ht) AS DOUBLE) AS ht, 'MA-FVR1' AS number, CAST(sum(ht) AS DOUBLE) AS ttc, CAST(1000.5 AS DOUBLE) AS collected, CAST(12 AS DOUBLE) AS payout FROM services GROUP BY month, half",
    "d18_bank_identity": f"WITH {D.LINES}, {D.PAYMENTS} SELECT DISTINCT dossier AS doc, 'ATTIJARI BANK' AS name, '000111222333444' AS ice, '1084612' AS fiscal FROM payments",
    "d19_bank_rows": f"WITH {D.LINES}, {D.PAYMENTS} SELECT dossier AS doc, CAST(date AS VARCHAR) AS date, CAST(amount AS DOUBLE) AS amount FROM payments",
}
