"""Queries of the scalar rules over derived ledger columns, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.sources import driver_tables as D

ACCENTS = f"translate({{}}, '{S.ACCENTED}', '{S.PLAIN}')"


def fold_sql(x: str) -> str:
    return f"trim(regexp_replace(upper({ACCENTS.format(f'coalesce({x}, {chr(39)}{chr(39)})')}), '\\s+', ' ', 'g'))"


# Raw texts: amounts and dates in the spellings that occur on documents and in bank files.
def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: its amount and date written in one of several ways."""
    t = D.table(spark, sf_dir, "lineitem")
    k = F.col("l_partkey") % 8
    a = F.col("l_extendedprice").cast(S.MONEY).cast("string")
    whole, cents = F.substring_index(a, ".", 1), F.substring_index(a, ".", -1)
    comma = F.concat(whole, F.lit(","), cents)
    amount = F.when(k == 0, comma).when(k == 1, F.concat(F.lit("-"), comma)).when(k == 2, F.concat(F.lit("("), a, F.lit(")"))).when(k == 3, F.concat(F.lit("1 "), a)).when(k == 4, F.concat(F.lit("1."), comma)).when(k == 5, F.concat(F.lit("1,"), a)).when(k == 6, F.concat(a, F.lit(" MAD"))).otherwise("--")
    d = F.col("l_shipdate")
    date = F.when(k == 0, F.date_format(d, "dd/MM/yyyy")).when(k == 1, F.date_format(d, "d-M-yy")).when(k == 2, F.date_format(d, "yyyy-MM-dd HH:mm")).when(k == 3, F.concat(F.lit("Le "), F.date_format(d, "d.M.yyyy"))).when(k == 4, F.concat(F.lit("31/02/"), F.date_format(d, "yyyy"))).when(k == 5, F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string")).when(k == 6, F.date_format(d, "yyyy/M/d")).otherwise("")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", amount.alias("amount"), date.alias("date"))


RAW = """
raw AS (
  SELECT l_orderkey, l_linenumber, l_partkey,
    CASE l_partkey % 8 WHEN 0 THEN replace(a, '.', ',') WHEN 1 THEN '-' || replace(a, '.', ',') WHEN 2 THEN '(' || a || ')' WHEN 3 THEN '1 ' || a WHEN 4 THEN '1.' || replace(a, '.', ',') WHEN 5 THEN '1,' || a WHEN 6 THEN a || ' MAD' ELSE '--' END AS amount,
    CASE l_partkey % 8 WHEN 0 THEN strftime(d, '%d/%m/%Y') WHEN 1 THEN strftime(d, '%-d-%-m-%y') WHEN 2 THEN strftime(d, '%Y-%m-%d %H:%M') WHEN 3 THEN 'Le ' || strftime(d, '%-d.%-m.%Y') WHEN 4 THEN '31/02/' || year(d) WHEN 5 THEN CAST(datediff('day', DATE '1899-12-30', CAST(d AS DATE)) AS VARCHAR) WHEN 6 THEN strftime(d, '%Y/%-m/%-d') ELSE '' END AS date
  FROM (SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS a, l_shipdate AS d FROM lineitem))"""
KEYS = "l_orderkey, l_linenumber, l_partkey"
#: After blanks are gone: which mark is decimal.
MARK = "CASE WHEN contains(x, ',') AND contains(x, '.') AND strpos(reverse(x), ',') < strpos(reverse(x), '.') THEN replace(replace(x, '.', ''), ',', '.') WHEN contains(x, ',') AND contains(x, '.') THEN replace(x, ',', '') ELSE replace(x, ',', '.') END"


def _raw(name, **cols):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return raw(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", *[make(F.col).alias(c) for c, make in cols.items()])

    query.__name__ = name
    return query


def _lines(name, *keys, **cols):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return D.invoice_lines(spark, sf_dir).select("dossier", "fact_num", "copy", "lib_frss", "ice_frs", "if_number", "source_file", "designation", "pct", "ht", "tva", "ttc", "date_fac", "source_id").select(*keys, *[make(F.col).alias(c) for c, make in cols.items()]).distinct()

    query.__name__ = name
    return query


def _names(name, **cols):
    """Over names of parts and suppliers' spellings."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        part = D.table(spark, sf_dir, "part").withColumn("label", F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 9 == 0, "consomable").when(F.col("p_partkey") % 9 == 1, "téléphonie Orange").when(F.col("p_partkey") % 9 == 2, "Commission banque").when(F.col("p_partkey") % 9 == 3, "honoraires d'expertise").when(F.col("p_partkey") % 9 == 4, "S.A.R.L. bon de service de livraison").when(F.col("p_partkey") % 9 == 5, "relevé de compte 20,00% et 10 %").when(F.col("p_partkey") % 9 == 6, "Facture ICE 000123456789012 TOTAL").when(F.col("p_partkey") % 9 == 7, "prestations de conseil 0% TVA").otherwise("12345678 x")))
        return part.select("p_partkey", *[make(F.col).alias(c) for c, make in cols.items()])

    query.__name__ = name
    return query


NAMES = """
names AS (SELECT p_partkey, concat_ws(' ', p_name, CASE p_partkey % 9 WHEN 0 THEN 'consomable' WHEN 1 THEN 'téléphonie Orange' WHEN 2 THEN 'Commission banque' WHEN 3 THEN 'honoraires d''expertise' WHEN 4 THEN 'S.A.R.L. bon de service de livraison' WHEN 5 THEN 'relevé de compte 20,00% et 10 %' WHEN 6 THEN 'Facture ICE 000123456789012 TOTAL' WHEN 7 THEN 'prestations de conseil 0% TVA' ELSE '12345678 x' END) AS label FROM part)"""


def _pages(name, **cols):
    """Over paths made of the pages' urls: drive exports, period and generic folders among them."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        k = F.col("page_id") % 6
        host = F.regexp_extract("url", r"//([^/]+)", 1)
        path = F.when(k == 0, F.concat(F.lit("factures/"), host, F.lit("/scan"), F.col("page_id"), F.lit(".pdf"))).when(k == 1, F.concat(host, F.lit("-20260816T102702Z-1-001/2026-06/a"), F.col("page_id"), F.lit("__RC__src-"), F.col("page_id"), F.lit(".pdf"))).when(k == 2, F.concat(F.lit("Juin 2026/Mose food_"), host, F.lit("/b.pdf"))).when(k == 3, F.concat(F.lit("c"), F.col("page_id"), F.lit(".pdf__RC__src-7"))).when(k == 4, F.concat(F.lit("./12345678901/"), host, F.lit(".PDF"))).otherwise(F.concat(F.lit("Documents/Trimestre 2/"), host))
        return D.table(spark, sf_dir, "pages").select("page_id", path.alias("path")).select("page_id", *[make(F.col).alias(c) for c, make in cols.items()])

    query.__name__ = name
    return query


PAGES = """
paths AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'factures/' || h || '/scan' || page_id || '.pdf' WHEN 1 THEN h || '-20260816T102702Z-1-001/2026-06/a' || page_id || '__RC__src-' || page_id || '.pdf' WHEN 2 THEN 'Juin 2026/Mose food_' || h || '/b.pdf' WHEN 3 THEN 'c' || page_id || '.pdf__RC__src-7' WHEN 4 THEN './12345678901/' || h || '.PDF' ELSE 'Documents/Trimestre 2/' || h END AS path
  FROM (SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS h FROM pages)),
parts AS (SELECT page_id, path, list_filter(string_split(path, '/'), lambda p: p <> '' AND p <> '.') AS parts FROM paths),
folders AS (SELECT page_id, path, parts[:-2] AS folders, list_filter(parts[:-2], lambda p: lower(trim(p)) NOT IN ('.', '..', 'unknown', 'factures', 'invoices', 'scans', 'documents', 'pdf') AND NOT regexp_full_match(p, '(.+)-\\d{8}T\\d{6}Z(-\\d+)+(_[a-z0-9]+)?', 'i') AND NOT regexp_full_match(p, '[\\d\\s._/-]+') AND NOT regexp_matches(p, '\\b(janvier|f[ée]vrier|mars|avril|mai|juin|juillet|ao[uû]t|septembre|octobre|novembre|d[ée]cembre|trimestre|semestre)\\b', 'i')) AS useful,
   list_filter(list_transform(parts[:-2], lambda p: trim(regexp_extract(p, '^(.+)-\\d{8}T\\d{6}Z(-\\d+)+(_[a-z0-9]+)?$', 1, 'i'))), lambda s: s <> '') AS stems FROM parts),
segments AS (SELECT page_id, path, coalesce(useful[1], stems[1], '') AS segment FROM folders),
labels_ AS (SELECT page_id, array_to_string(list_transform(list_filter(regexp_split_to_array(segment, '[\\s_-]+'), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label FROM segments)"""

KINDS = "('MATIERES CONSOMMABLES', 'PRESTATIONS', 'TELEPHONIE', 'FRAIS BANCAIRE')"

QUERIES = {
    "b01_money_document": _raw("b01", value=lambda c: S.money_document(c("amount"))),
    "b02_money_bank": _raw("b02", value=lambda c: S.money_bank(c("amount"))),
    "b03_money_delivery": _raw("b03", value=lambda c: S.money_delivery(c("amount"))),
    "b04_date_bank": _raw("b04", day=lambda c: S.date_bank(c("date"))),
    "b05_date_document": _raw("b05", day=lambda c: S.date_document(c("date")).cast("string")),
    "b06_fold_text": _lines("b06", "lib_frss", folded=lambda c: S.fold(F.concat(F.lit("  Crédit  "), c("lib_frss"), F.lit("\tà Fès")))),
    "b07_supplier_key": _lines("b07", "lib_frss", key=lambda c: S.supplier_key(c("lib_frss"))),
    "b08_company_id": _lines("b08", "ice_frs", "pct", ice=lambda c: S.ice(F.concat(F.lit("ICE: "), F.substring(c("ice_frs"), 1, 8), F.lit(" "), F.substring(c("ice_frs"), F.lit(9), F.when(c("pct") == 20, 6).otherwise(7))))),
    "b09_fiscal_id": _lines("b09", "if_number", "ice_frs", fiscal=lambda c: S.fiscal_id(F.concat(F.lit("IF "), F.when(c("if_number") == "", c("ice_frs")).otherwise(c("if_number"))))),
    "b10_designation": _names("b10", kind=lambda c: S.designation(F.concat_ws(" ", c("p_name"), F.split(F.lit("consomable|telephonie|banque|service|"), r"\|")[(c("p_partkey") % 5).cast("int")]))),
    "b11_designation_of_text": _names("b11", kind=lambda c: S.designation_of_text(F.concat_ws(" ", c("p_name"), c("label")))),
    "b12_rate": _raw("b12", rate=lambda c: S.rate((c("l_partkey") % 45).cast("double") / F.when(c("l_linenumber") % 2 == 0, 100.0).otherwise(2.0))),
    "b13_rate_from_amounts": _lines("b13", "ht", "tva", pct_found=lambda c: S.rate_from_amounts(c("ht"), c("tva"))),
    "b14_vat_code": _lines("b14", "designation", "pct", code=lambda c: S.vat_code(c("designation"), c("pct"))),
    "b15_plausible_name": _names("b15", plausible=lambda c: S.plausible_name(c("label"))),
    "b16_top_folder": _pages("b16", folder=lambda c: S.top_folder(c("path"))),
    "b17_supplier_folder": _pages("b17", folder=lambda c: S.supplier_folder(c("path"))),
    "b18_supplier_hint": _pages("b18", hint=lambda c: S.supplier_hint(c("path"))),
    "b19_source_tag": _pages("b19", file=lambda c: S.split_tag(c("path"))["file"], tag=lambda c: S.split_tag(c("path"))["id"]),
    "b20_identity_keys": _pages("b20", keys=lambda c: F.array_join(S.identity_keys(c("path")), "|")),
    "b22_period_code": _lines("b22", "date_fac", code=lambda c: S.period_code(F.year(c("date_fac")), F.month(c("date_fac"))), month_back=lambda c: S.period_parts(S.period_code(F.year(c("date_fac")), F.month(c("date_fac"))))["month"], bad=lambda c: S.period_parts(F.lit("132026"))["month"]),
    "b25_half_month": _lines("b25", "date_fac", half=lambda c: S.half_month(F.dayofmonth(c("date_fac")))),
    "b27_credit_note": _lines("b27", "fact_num", "source_file", credit=lambda c: S.credit_note(c("source_file"), c("fact_num"))),
    "b28_signed_total": _lines("b28", "fact_num", "ttc", signed=lambda c: S.signed_total(c("ttc"), S.credit_note(c("fact_num"))).cast("double")),
    "b29_rate_mentions": _names("b29", mentions=lambda c: F.array_join(S.rate_mentions(c("label")).cast("array<string>"), ",")),
    "b30_useful_text": _names("b30", useful=lambda c: S.useful_text(c("label"), 30)),
    "b31_difficult": _names("b31", hard=lambda c: S.difficult(F.array(c("p_name"), F.when(c("p_partkey") % 3 == 0, "Scan difficile à lire").otherwise("ok")))),
    "b33_deadline": _lines("b33", "date_fac", due=lambda c: S.deadline(F.year(c("date_fac")), F.month(c("date_fac"))).cast("string"), days=lambda c: S.days_left(F.year(c("date_fac")), F.month(c("date_fac")), F.lit("2024-06-15 12:00:00").cast("timestamp"))),
    "b34_serial": _lines("b34", "date_fac", serial=lambda c: S.serial(c("date_fac"))),
}


def b24_beneficiary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.payments(spark, sf_dir).select("dossier", "txn", S.beneficiary(F.col("label")).alias("token"))


def b26_order_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.platform_orders(spark, sf_dir).select("order_id", S.delivered(F.col("status")).alias("delivered"), S.returned_or_cancelled(F.col("status")).alias("undone"))


def b32_label_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each payment's label against the supplier and number of its own order."""
    p = D.payments(spark, sf_dir)
    number = F.concat(F.lit("F"), F.substring("txn", 2, 20))
    supplier = F.concat(F.lit("Supplier#"), F.lpad((F.substring("txn", 2, 20).cast("long") % 10).cast("string"), 9, "0"))
    return p.select("dossier", "txn", S.label_score(F.col("label"), supplier, number).alias("score"))


def b36_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break each field constraint."""
    lines, jobs = D.invoice_lines(spark, sf_dir), D.import_jobs(spark, sf_dir)
    of_lines = {"ice is 15 digits": F.col("ice_frs").rlike(r"^\d{15}$"), "rate is known": F.col("pct").isin(0, 10, 20), "supplier is named": F.col("lib_frss") != "", "amounts are not negative": (F.col("ht") >= 0) & (F.col("tva") >= 0) & (F.col("ttc") >= 0)}
    of_jobs = {"status is known": F.col("status").isin("uploading", "queued", "processing", "done", "failed"), "processed is at most total": F.col("processed") <= F.col("total")}

    def report(df: DataFrame, rules: dict) -> DataFrame:
        counts = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
        return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("violations")) for n in rules])).alias("r")).select("r.*")

    return report(lines, of_lines).unionByName(report(jobs, of_jobs))


QUERIES |= {"b24_beneficiary": b24_beneficiary, "b26_order_status": b26_order_status, "b32_label_score": b32_label_score, "b36_constraints": b36_constraints}

_KEY = "array_to_string(list_filter(regexp_split_to_array(upper(regexp_replace(" + ACCENTS.format("{}") + ", '[.''’]', '', 'g')), '[^A-Z0-9]+'), lambda t: t <> '' AND t NOT IN ('SARL','SARLAU','SA','SAS','SASU','SNC','SCS','STE','SOCIETE','AU','EURL')), '')"


def key_sql(x: str) -> str:
    return _KEY.replace("{}", x)


DMY, YMD = r"(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})", r"(\d{4})[/.\-](\d{1,2})[/.\-](\d{1,2})"
ORACLES = {
    "b01_money_document": f"WITH {RAW}, c AS (SELECT *, regexp_replace(regexp_replace(replace(amount, ' ', ''), '^[-(]+', ''), '\\)+$', '') AS x FROM raw) SELECT {KEYS}, CASE WHEN left(amount, 1) IN ('-', '(') THEN -abs(TRY_CAST({MARK} AS DOUBLE)) ELSE TRY_CAST({MARK} AS DOUBLE) END AS value FROM c",
    "b02_money_bank": f"WITH {RAW}, c AS (SELECT *, regexp_replace(replace(amount, ' ', ''), '[^0-9,.\\-]', '', 'g') AS x FROM raw) SELECT {KEYS}, CASE WHEN left(amount, 1) IN ('-', '(') THEN -abs(TRY_CAST({MARK} AS DOUBLE)) ELSE TRY_CAST({MARK} AS DOUBLE) END AS value FROM c",
    "b03_money_delivery": f"WITH {RAW} SELECT {KEYS}, coalesce(TRY_CAST(replace(replace(replace(amount, 'MAD', ''), ',', ''), ' ', '') AS DOUBLE), 0.0) AS value FROM raw",
    "b04_date_bank": f"WITH {RAW}, m AS (SELECT *, regexp_extract(date, '^(\\d{{1,2}})[/.\\-](\\d{{1,2}})[/.\\-](\\d{{2,4}})', ['d', 'm', 'y']) AS f FROM raw) SELECT {KEYS}, CASE WHEN TRY_CAST(date AS DOUBLE) BETWEEN 30001 AND 59999 THEN strftime(DATE '1899-12-30' + CAST(date AS INTEGER), '%Y-%m-%d') WHEN regexp_matches(date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN left(date, 10) WHEN f.y <> '' THEN CASE WHEN length(f.y) = 2 THEN '20' ELSE '' END || f.y || '-' || lpad(f.m, 2, '0') || '-' || lpad(f.d, 2, '0') ELSE '' END AS day FROM m",
    "b05_date_document": f"WITH {RAW}, m AS (SELECT *, regexp_extract(date, '{DMY}', ['d', 'm', 'y']) AS f, regexp_extract(date, '{YMD}', ['y', 'm', 'd']) AS g FROM raw) SELECT {KEYS}, CAST(coalesce(TRY_CAST(f.y || '-' || lpad(f.m, 2, '0') || '-' || lpad(f.d, 2, '0') AS DATE), TRY_CAST(g.y || '-' || lpad(g.m, 2, '0') || '-' || lpad(g.d, 2, '0') AS DATE)) AS VARCHAR) AS day FROM m",
    "b06_fold_text": f"WITH {D.LINES} SELECT DISTINCT lib_frss, {fold_sql(chr(39) + '  Crédit  ' + chr(39) + ' || lib_frss || chr(9) || ' + chr(39) + 'à Fès' + chr(39))} AS folded FROM lines",
    "b07_supplier_key": f"WITH {D.LINES} SELECT DISTINCT lib_frss, {key_sql('lib_frss')} AS key FROM lines",
    "b08_company_id": f"WITH {D.LINES}, d AS (SELECT ice_frs, pct, left(ice_frs, 8) || substr(ice_frs, 9, CASE WHEN pct = 20 THEN 6 ELSE 7 END) AS x FROM lines) SELECT DISTINCT ice_frs, pct, CASE WHEN length(x) = 15 THEN x ELSE '' END AS ice FROM d",
    "b09_fiscal_id": f"WITH {D.LINES}, d AS (SELECT if_number, ice_frs, CASE WHEN if_number = '' THEN ice_frs ELSE if_number END AS x FROM lines) SELECT DISTINCT if_number, ice_frs, CASE WHEN length(x) = 15 THEN '' ELSE x END AS fiscal FROM d",
    "b10_designation": f"WITH d AS (SELECT p_partkey, upper(trim(regexp_replace(concat_ws(' ', p_name, ['consomable', 'telephonie', 'banque', 'service', ''][p_partkey % 5 + 1]), '\\s+', ' ', 'g'))) AS t FROM part), e AS (SELECT *, replace(replace(replace(t, 'MATIERE ', 'MATIERES '), 'CONSOMABLE', 'CONSOMMABLES'), 'CONSOMABLES', 'CONSOMMABLES') AS x FROM d) SELECT p_partkey, CASE WHEN t IN {KINDS} THEN t WHEN x IN {KINDS} THEN x WHEN regexp_matches(t, 'TELEPHON|ORANGE|INWI|IAM') THEN 'TELEPHONIE' WHEN regexp_matches(t, 'BANCAIRE|BANQUE|COMMISSION') THEN 'FRAIS BANCAIRE' WHEN regexp_matches(t, 'PRESTATION|SERVICE|HONORAIRE') THEN 'PRESTATIONS' ELSE 'MATIERES CONSOMMABLES' END AS kind FROM e",
    "b11_designation_of_text": f"WITH {NAMES}, d AS (SELECT p_partkey, lower(label) AS t FROM names) SELECT p_partkey, CASE WHEN regexp_matches(t, 'téléphon|telephon|abonnement mobile|forfait') THEN 'TELEPHONIE' WHEN regexp_matches(t, 'relevé de compte|releve de compte|agios|frais bancaire') THEN 'FRAIS BANCAIRE' WHEN regexp_matches(t, '\\b(prestations?|honoraires?|frais de service)\\b') OR regexp_matches(replace(t, 'bon de service de livraison', ''), '\\bservice de livraison\\b') THEN 'PRESTATIONS' ELSE 'MATIERES CONSOMMABLES' END AS kind FROM d",
    "b12_rate": f"WITH {RAW}, v AS (SELECT *, CAST(l_partkey % 45 AS DOUBLE) / CASE WHEN l_linenumber % 2 = 0 THEN 100.0 ELSE 2.0 END AS v FROM raw), r AS (SELECT *, CASE WHEN abs(v) > 1 THEN v / CAST(100 AS DOUBLE) ELSE v END AS r FROM v) SELECT {KEYS}, CAST(CASE WHEN abs(r) <= 0.015::DOUBLE THEN 0.0 WHEN abs(r - 0.1::DOUBLE) <= 0.015::DOUBLE THEN 0.1 WHEN abs(r - 0.2::DOUBLE) <= 0.015::DOUBLE THEN 0.2 END AS DOUBLE) AS rate FROM r",
    "b13_rate_from_amounts": f"WITH {D.LINES} SELECT DISTINCT ht, tva, CASE WHEN abs(ht) < 0.01 THEN 20 WHEN abs(tva) < 0.05 THEN 0 WHEN abs(tva) BETWEEN abs(ht) * 0.075 AND abs(ht) * 0.125 THEN 10 ELSE 20 END AS pct_found FROM lines",
    "b14_vat_code": f"WITH {D.LINES}, codes(d, p, code) AS (VALUES ('MATIERES CONSOMMABLES', 20, 146), ('MATIERES CONSOMMABLES', 10, 150), ('PRESTATIONS', 20, 140), ('TELEPHONIE', 20, 140), ('FRAIS BANCAIRE', 10, 142)) SELECT DISTINCT designation, pct, code FROM lines LEFT JOIN codes ON d = designation AND p = pct",
    "b15_plausible_name": f"WITH {NAMES} SELECT p_partkey, length(label) BETWEEN 4 AND 60 AND length(regexp_replace(label, '[^\\p{{L}}]', '', 'g')) >= 4 AND length(regexp_replace(label, '[^0-9]', '', 'g')) * 4 <= length(label) AND regexp_matches(lower(label), '[aeiouyàâéèêîôûü]') AND len(regexp_split_to_array(trim(label), '\\s+')) <= 6 AS plausible FROM names",
    "b16_top_folder": f"WITH {PAGES} SELECT page_id, CASE WHEN contains(path, '/') THEN lower(trim(split_part(path, '/', 1))) ELSE '' END AS folder FROM paths",
    "b17_supplier_folder": f"WITH {PAGES} SELECT page_id, segment AS folder FROM segments",
    "b18_supplier_hint": f"WITH {PAGES} SELECT page_id, CASE WHEN label <> '' AND length(regexp_replace(label, '\\D', '', 'g')) <= greatest(3.0, length(label) / 4) THEN label END AS hint FROM labels_",
    "b19_source_tag": f"WITH {PAGES}, t AS (SELECT page_id, path, regexp_extract(path, '^(.*)__RC__(src-\\d+)(\\.[^./]+)?$', ['a', 'b', 'c']) AS m FROM paths) SELECT page_id, CASE WHEN m.b <> '' THEN m.a || m.c ELSE path END AS file, m.b AS tag FROM t",
    "b20_identity_keys": f"WITH {PAGES}, s AS (SELECT page_id, list_filter(string_split(lower(path), '/'), lambda p: p <> '') AS p FROM paths) SELECT page_id, CASE WHEN len(p) > 1 THEN p[-2] || '/' || p[-1] || '|' || p[-1] ELSE p[-1] END AS keys FROM s",
    "b22_period_code": f"WITH {D.LINES} SELECT DISTINCT date_fac, strftime(date_fac, '%m%Y') AS code, CAST(month(date_fac) AS INTEGER) AS month_back, CAST(NULL AS INTEGER) AS bad FROM lines",
    "b24_beneficiary": f"WITH {D.LINES}, {D.PAYMENTS} SELECT dossier, txn, regexp_replace(regexp_extract({fold_sql('label')}, 'EN FAVEUR DE\\s+([^,]+)', 1), '[^A-Z0-9]', '', 'g') AS token FROM payments",
    "b25_half_month": f"WITH {D.LINES} SELECT DISTINCT date_fac, CASE WHEN day(date_fac) <= 15 THEN 'q1' ELSE 'q2' END AS half FROM lines",
    "b26_order_status": f"WITH {D.ORDERS} SELECT order_id, status = 'DELIVERED' AS delivered, status LIKE '%RETURN%' OR status LIKE '%CANCEL%' AS undone FROM porders",
    "b27_credit_note": f"WITH {D.LINES} SELECT DISTINCT fact_num, source_file, contains(lower(source_file || ' ' || fact_num), 'avoir') AS credit FROM lines",
    "b28_signed_total": f"WITH {D.LINES} SELECT DISTINCT fact_num, ttc, CAST(CASE WHEN fact_num LIKE 'AVOIR%' OR ttc < 0 THEN -abs(ttc) ELSE ttc END AS DOUBLE) AS signed FROM lines",
    "b29_rate_mentions": f"WITH {NAMES} SELECT p_partkey, CASE p_partkey % 9 WHEN 5 THEN '10,20' WHEN 7 THEN '0' ELSE '' END AS mentions FROM names",
    "b30_useful_text": f"WITH {NAMES} SELECT p_partkey, length(regexp_replace(label, '\\s', '', 'g')) >= 30 AND (regexp_matches(label, '\\d{{15}}') OR regexp_matches(label, 'total|facture|\\bice\\b', 'i')) AS useful FROM names",
    "b31_difficult": "SELECT p_partkey, regexp_matches(lower(p_name), 'difficile|illisible|flou|faible') OR p_partkey % 3 = 0 AS hard FROM part",
    "b32_label_score": f"WITH {D.LINES}, {D.PAYMENTS}, x AS (SELECT dossier, txn, {fold_sql('label')} AS hay, 'F' || substr(txn, 2) AS num, 'SUPPLIER#' || lpad(CAST(CAST(substr(txn, 2) AS BIGINT) % 10 AS VARCHAR), 9, '0') AS sup FROM payments) SELECT dossier, txn, CASE WHEN contains(hay, sup) THEN 2 ELSE 0 END + CASE WHEN contains(hay, num) THEN 3 ELSE 0 END AS score FROM x",
    "b33_deadline": f"WITH {D.LINES}, d AS (SELECT DISTINCT date_fac, date_trunc('month', date_fac) + INTERVAL 1 MONTH + INTERVAL 19 DAY + INTERVAL 86399 SECOND AS due FROM lines) SELECT date_fac, strftime(due, '%Y-%m-%d %H:%M:%S') AS due, CAST(ceil((epoch(due) - epoch(TIMESTAMP '2024-06-15 12:00:00')) / 86400.0) AS INTEGER) AS days FROM d",
    "b34_serial": f"WITH {D.LINES} SELECT DISTINCT date_fac, CAST(datediff('day', DATE '1899-12-30', date_fac) AS INTEGER) AS serial FROM lines",
    "b36_constraints": f"WITH {D.LINES}, {D.JOBS} SELECT 'ice is 15 digits' AS rule, count(*) FILTER (NOT regexp_full_match(ice_frs, '\\d{{15}}')) AS violations FROM lines UNION ALL SELECT 'rate is known', count(*) FILTER (pct NOT IN (0, 10, 20)) FROM lines UNION ALL SELECT 'supplier is named', count(*) FILTER (lib_frss = '') FROM lines UNION ALL SELECT 'amounts are not negative', count(*) FILTER (NOT (ht >= 0 AND tva >= 0 AND ttc >= 0)) FROM lines UNION ALL SELECT 'status is known', count(*) FILTER (status NOT IN ('uploading', 'queued', 'processing', 'done', 'failed')) FROM jobs UNION ALL SELECT 'processed is at most total', count(*) FILTER (processed > total) FROM jobs",
}
