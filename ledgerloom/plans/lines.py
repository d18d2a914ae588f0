"""Queries over ledger lines: amount rules, suppliers, duplicates, review; with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import amounts as A
from ledgerloom.functions import scalars as S
from ledgerloom.functions.lineage import cut
from ledgerloom.operators import lines as L
from ledgerloom.plans.scalars import key_sql
from ledgerloom.sources import driver_tables as D

KEY = ["dossier", "pos"]


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.credit(D.invoice_lines(spark, sf_dir))


def amounts(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*KEY, *[F.col(c).cast("double").alias(c) for c in ("ht", "tva", "ttc")], *more)


def c01_credit_signs(spark, sf_dir):
    """Amounts with the signs of credit notes."""
    return amounts(L.apply_credit_signs(base(spark, sf_dir)))


def c04_repair(spark, sf_dir):
    """Impossible amounts repaired."""
    return amounts(A.repair(base(spark, sf_dir)), "pct", "sanitized")


def c05_fill_total(spark, sf_dir):
    """Missing TTC filled."""
    return base(spark, sf_dir).select(*KEY, A.fill_total(F.col("ht"), F.col("tva"), F.col("ttc"), F.col("pct")).cast("double").alias("ttc"))


def c06_coherent(spark, sf_dir):
    """Lines by whether their amounts cohere, and C7: by whether they blend rates."""
    return base(spark, sf_dir).select(*KEY, A.coherent(F.col("ht"), F.col("tva"), F.col("ttc"), F.col("pct")).alias("coherent"))


def c07_blended(spark, sf_dir):
    """First line of each document whose overall rate lies between two rates."""
    df = base(spark, sf_dir).where(A.blended(F.col("ht"), F.col("tva")))
    return df.groupBy("dossier", "source_file").agg(F.min("pos").alias("pos"), F.min_by("fact_num", "pos").alias("fact_num"))


def c11_recompute(spark, sf_dir):
    """VAT and TTC computed anew from HT and rate."""
    r = D.invoice_lines(spark, sf_dir).withColumn("r", A.recompute(F.col("ht"), F.col("pct")))
    return r.select(*KEY, F.col("r.tva").cast("double").alias("tva"), F.col("r.ttc").cast("double").alias("ttc"))


def c12_fee_lines(spark, sf_dir):
    """Ledger lines of bank fees."""
    p = D.payments(spark, sf_dir).where(S.fold(F.col("label")).rlike(S.FEE_WORDS) & (F.col("amount") < 0)).withColumn("total", F.abs("amount")).withColumn("s", A.fee_split(F.col("total")))
    return p.select("dossier", "txn", F.concat(F.lit("FRAIS-"), F.col("date").cast("string")).alias("fact_num"), F.col("s.ht").cast("double").alias("ht"), F.col("s.tva").cast("double").alias("tva"), F.col("total").cast("double").alias("ttc"))


def c13_bulk_replace(spark, sf_dir):
    """Company ids replaced by a table of edits (old id to new id), and whether each line changed."""
    lines = D.invoice_lines(spark, sf_dir)
    edits = lines.where("ice_frs <> ''").select("ice_frs").distinct().where(F.col("ice_frs").cast("long") % 3 == 0).select("ice_frs", F.lpad((F.col("ice_frs").cast("long") + 5000).cast("string"), 15, "0").alias("new"))
    return lines.join(edits, "ice_frs", "left").select(*KEY, F.coalesce("new", "ice_frs").alias("ice_frs"), F.col("new").isNotNull().alias("changed"))


def c14_supplier_fill(spark, sf_dir):
    """Empty fiscal ids filled from edits by supplier."""
    lines = D.invoice_lines(spark, sf_dir).withColumn("key", S.supplier_key(F.col("lib_frss")))
    edits = lines.select("key").distinct().select("key", F.concat(F.lit("9"), F.substring("key", -3, 3)).alias("new"))
    return lines.join(edits, "key").select(*KEY, F.when(F.col("if_number") == "", F.col("new")).otherwise(F.col("if_number")).alias("if_number"))


def c16_apply_payment(spark, sf_dir):
    """Payment dates of confirmed payments written to the lines of their invoice."""
    lines, p = D.invoice_lines(spark, sf_dir), D.payments(spark, sf_dir)
    paid = p.where("amount < 0").select("dossier", F.concat(F.lit("F"), F.substring("txn", 2, 20)).alias("fact_num"), F.col("date").alias("paid_on"))
    return lines.join(paid, ["dossier", "fact_num"], "left").select(*KEY, F.coalesce("paid_on", "date_paie").cast("string").alias("date_paie"), F.when(F.col("paid_on").isNotNull(), 4).alias("id_paie"), F.col("paid_on").isNotNull().alias("from_bank"))


def c17_status(spark, sf_dir):
    """Status of each period: exported stays, otherwise in review once it has lines."""
    periods = D.table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 300).alias("client"), (F.floor(F.col("o_custkey") / 300) * 1000 + (F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate")).alias("dossier")).distinct()
    counts = D.invoice_lines(spark, sf_dir).groupBy("dossier").agg(F.count("*").alias("n"))
    return periods.join(counts, "dossier", "left").select("dossier", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("dossier") % 5 == 0, "exported").when(F.col("n") > 0, "in_review").otherwise("draft").alias("status"))


def f02_most_common_name(spark, sf_dir):
    """Most common spelling of each company id's name."""
    return L.most_common(D.invoice_lines(spark, sf_dir).where("ice_frs <> ''"), ["ice_frs"], F.col("lib_frss"), "name")


def f03_best_ice(spark, sf_dir):
    """Best company id of each supplier, not the client's own."""
    df = D.invoice_lines(spark, sf_dir).withColumn("key", S.supplier_key(F.col("lib_frss")))
    return L.best_ice(df, ["client", "key"], F.lpad((F.col("client") + 1).cast("string"), 15, "0"))


def f04_canonical_name(spark, sf_dir):
    """Most frequent, then longest, then first spelling of each supplier."""
    df = D.invoice_lines(spark, sf_dir).withColumn("key", S.supplier_key(F.col("lib_frss")))
    n = df.groupBy("key", "lib_frss").agg(F.count("*").alias("n"))
    return n.groupBy("key").agg(F.max_by("lib_frss", F.struct("n", F.length("lib_frss"), "lib_frss")).alias("name"))


def f05_first_identifier(spark, sf_dir):
    """First non-empty fiscal id of each supplier and dossier, in line order."""
    df = D.invoice_lines(spark, sf_dir).withColumn("key", S.supplier_key(F.col("lib_frss"))).where("if_number <> ''")
    return df.groupBy("dossier", "key").agg(F.min_by("if_number", "pos").alias("if_number"))


def f06_complete_identifiers(spark, sf_dir):
    """Missing identifiers completed from the supplier's other lines."""
    return L.complete_identifiers(D.invoice_lines(spark, sf_dir), ["dossier"]).select(*KEY, "ice_frs", "if_number", "ice_inferred", "if_inferred")


def f07_normalise_groups(spark, sf_dir):
    """Identifiers and missing names filled by folder or supplier group."""
    df = D.invoice_lines(spark, sf_dir).select(*KEY, "source_file", "lib_frss", "ice_frs", "if_number", "from_folder").withColumns({"lib_frss": F.when(F.col("pos") % 8 == 3, "").otherwise(F.col("lib_frss")), "source_file": F.regexp_replace("source_file", r"Supplier#0*(?=\d)", "maison_du-RIAD ")})
    return L.normalise_groups(df).select(*KEY, "group", "ice_frs", "if_number", "lib_frss", "from_folder")


def f08_consolidate(spark, sf_dir):
    """Lines of one number and rate merged where some lack VAT."""
    return amounts(L.consolidate(D.invoice_lines(spark, sf_dir)), "merged")


def g01_duplicates(spark, sf_dir):
    """Lines that repeat an earlier one."""
    return L.mark_duplicates(D.invoice_lines(spark, sf_dir)).select(*KEY, "duplicate")


def g02_remove_duplicates(spark, sf_dir):
    """Lines without repeats."""
    return L.remove_duplicates(D.invoice_lines(spark, sf_dir)).select(*KEY, "fact_num")


def g03_merge(spark, sf_dir):
    """New lines (the copies) merged into the ledgers (every other original line)."""
    lines = D.invoice_lines(spark, sf_dir)
    return L.merge_lines(lines.where("copy = 0 and pos % 2 = 0"), lines.where("copy = 1 or pos % 2 = 1")).select(*KEY, "origin")


def reviewed(spark, sf_dir) -> DataFrame:
    """Lines after signs, repair, completion and duplicate marks, with the confidence of each field."""
    lines = L.repair(L.credit_by_list(D.invoice_lines(spark, sf_dir)))
    df = L.complete_and_mark(cut(lines.withColumn("line", F.monotonically_increasing_id())), ["dossier"], "line")
    return L.confidence(df, F.lpad((F.col("client") + 1).cast("string"), 15, "0"))


def j01_confidence(spark, sf_dir):
    """Level and reason of every field of every line."""
    return reviewed(spark, sf_dir).select(*KEY, F.explode("conf").alias("field", "c")).select(*KEY, "field", "c.level", "c.reason")


def _anomaly():
    return L.has_anomaly(F.col("conf"), F.col("verified"), F.col("duplicate"), F.col("dismissed"))


def j03_anomalies(spark, sf_dir):
    """Lines that need action, and lines with anything to review."""
    return reviewed(spark, sf_dir).select(*KEY, _anomaly().alias("anomaly"), L.needs_review(F.col("conf"), F.col("duplicate")).alias("review"))


def j04_issue_summary(spark, sf_dir):
    """Per line its issues that are not soft."""
    found = L.issues(F.col("conf"), F.col("verified"), F.col("duplicate"), F.col("dismissed"))
    names = lambda level: F.array_join(F.array_sort(F.transform(F.filter("found", lambda e: e["level"] == level), lambda e: e["field"])), ",")
    return reviewed(spark, sf_dir).select(*KEY, found.alias("found")).select(*KEY, names("error").alias("errors"), names("warn").alias("warns"))


def j05_review_list(spark, sf_dir):
    """Distinct issues of each dossier's lines, worst first."""
    return L.review_list(reviewed(spark, sf_dir))


def f14_anomaly_count(spark, sf_dir):
    """Lines, anomalies and missing payment dates of each dossier (with F15 and F17)."""
    df = reviewed(spark, sf_dir)
    return df.groupBy("dossier").agg(F.count("*").alias("n"), F.count_if(_anomaly()).alias("anomalies"), F.count_if(F.col("date_paie").isNull() & (F.col("designation") != S.BANK_FEES)).alias("unpaid"))


def c15_review_marks(spark, sf_dir):
    """Marks after a user checked some lines, confirmed company ids on others and took marks back."""
    df = L.mark_duplicates(D.invoice_lines(spark, sf_dir)).withColumn("ice_inferred", F.col("ice_frs") == "")
    df = L.verify_line(df, F.col("ht") > 50000)
    df = L.verify_field(df, F.col("pct") == 10, "ice_frs")
    df = L.unverify_line(df, F.col("ttc") == 0)
    return df.select(*KEY, F.array_join(F.array_sort("verified"), ",").alias("marks"), "dismissed", "ice_inferred")


def c18_stored(spark, sf_dir):
    """Reviewed lines as stored records, the confidence as text."""
    c = F.array_join(F.array_sort(F.transform(F.map_entries("field_confidence"), lambda e: F.concat_ws(":", e["key"], e["value"]["level"], e["value"]["reason"]))), ",")
    df = L.stored(reviewed(spark, sf_dir))
    return df.withColumns({"field_confidence": c, "user_verified_fields": F.array_join("user_verified_fields", ",")}).withColumns({k: F.col(k).cast("double") for k in ("m_ht", "tva", "m_ttc", "taux")})


def f26_issue_counts(spark, sf_dir):
    """Errors and warnings by field."""
    e = reviewed(spark, sf_dir).select("dossier", F.explode("conf").alias("field", "c"))
    return e.groupBy("dossier", "field").agg(F.count_if(F.col("c.level") == "error").alias("errors"), F.count_if(F.col("c.level") == "warn").alias("warns"))


def declaration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAT declaration of repaired lines: totals by client, period, designation and rate with the VAT code."""
    df = L.repair(base(spark, sf_dir))
    return df.groupBy("client", "period", "designation", "pct").agg(F.count("*").alias("n"), *[F.sum(c).cast("double").alias(c) for c in ("ht", "tva", "ttc")]).withColumn("code", S.vat_code(F.col("designation"), F.col("pct")))


def a12_declaration_rows(spark, sf_dir):
    """Rows of the declaration: 14 columns in order, one per line."""
    df = L.repair(base(spark, sf_dir))
    cols = {
        "or_": F.col("pos"), "fact_num": F.col("fact_num"), "designation": F.col("designation"), "m_ht": F.col("ht").cast("double"), "tva": F.col("tva").cast("double"), "m_ttc": F.col("ttc").cast("double"),
        "if_frs": S.fiscal_id(F.col("if_number")), "lib_frss": F.col("lib_frss"), "ice_frs": S.ice(F.col("ice_frs")), "taux": (F.col("pct") / 100.0), "id_paie": F.lit(4), "date_paie": S.serial(F.col("date_paie")), "date_fac": S.serial(F.col("date_fac")), "code_tva": S.vat_code(F.col("designation"), F.col("pct")),
    }
    return df.select("dossier", *[c.alias(k) for k, c in cols.items()])


QUERIES = {f.__name__: f for f in (
    c01_credit_signs, c04_repair, c05_fill_total, c06_coherent, c07_blended, c11_recompute, c12_fee_lines, c13_bulk_replace, c14_supplier_fill, c16_apply_payment, c17_status,
    f02_most_common_name, f03_best_ice, f04_canonical_name, f05_first_identifier, f06_complete_identifiers, f07_normalise_groups, f08_consolidate, g01_duplicates, g02_remove_duplicates, g03_merge,
    c15_review_marks, c18_stored, j01_confidence, j03_anomalies, j04_issue_summary, j05_review_list, f14_anomaly_count, f26_issue_counts, declaration, a12_declaration_rows,
)}

# Twins ---------------------------------------------------------------------
CREDIT = f"{D.LINES}, credited AS (SELECT *, max(contains(lower(source_file || ' ' || fact_num), 'avoir')) OVER (PARTITION BY dossier, source_file) AS credit FROM lines)"


def near(a: str, b: str, lo: float, hi: float) -> str:
    return f"(abs({a}) >= abs({b}) * {lo} AND abs({a}) <= abs({b}) * {hi})"


BLEND = lambda h, v: f"(abs({h}) >= 0.01 AND abs({v}) >= 0.01 AND {near(v, h, 0.085, 0.215)} AND NOT {near(v, h, 0.085, 0.115)} AND NOT {near(v, h, 0.185, 0.215)})"
FITS = lambda h, v, t, p: f"CASE WHEN abs({h}) <= 0.01 THEN true WHEN {p} = 0 THEN abs({v}) <= 0.05 AND abs(abs({h}) - abs({t})) <= 0.05 WHEN {p} = 10 THEN {near(v, h, 0.075, 0.125)} ELSE {near(v, h, 0.175, 0.225)} END"
COHERENT = f"(NOT (abs(ht) < 0.01 AND abs(ttc) < 0.01) AND abs(abs(ht) + abs(tva) - abs(ttc)) <= greatest(0.05, abs(ttc) * 0.01) AND {FITS('ht', 'tva', 'ttc', 'pct')})"
#: HT of a total at a rate, half up in whole cents.
HT = lambda t, p: f"CAST(CASE {p} WHEN 0 THEN CAST({t} * 100 AS BIGINT) WHEN 10 THEN (CAST({t} * 100 AS BIGINT) * 20 + 11) // 22 ELSE (CAST({t} * 100 AS BIGINT) * 10 + 6) // 12 END AS DECIMAL(18,0)) * 0.01"
REPAIRED = f"""{CREDIT},
m AS (SELECT *, abs(ht) AS h, abs(tva) AS v, abs(ttc) AS t, CASE WHEN credit THEN -1 ELSE 1 END AS sgn FROM credited),
m1 AS (SELECT *, CASE WHEN (h > 0.01 AND v * 4 <= h) OR (t < 50 AND v < 50) THEN NULL WHEN abs(h - 20) <= 0.01 OR h = 0.2 THEN 20 WHEN abs(h - 10) <= 0.01 OR h = 0.1 THEN 10 END AS typed, list_sort([h, v, t]) AS o FROM m),
m2 AS (SELECT *, CASE WHEN t < 50 AND v > 50 THEN CAST(round(v * 100 / typed, 2) AS DECIMAL(18,2)) ELSE t END AS typed_total, o[3] > 0.01 AND abs(o[2] + o[1] - o[3]) <= 0.05 AND o[2] > 0.01 AS ord,
  CASE WHEN h >= 0.01 AND v <= 0.05 AND abs(h - t) <= 0.05 THEN 'zero' END AS k0 FROM m1),
m3 AS (SELECT *, CASE WHEN k0 IS NOT NULL THEN k0 WHEN typed IS NOT NULL THEN 'typed'
   WHEN (NOT (h < 0.01 AND t < 0.01) AND abs(h + v - t) <= 0.05 AND {FITS('h', 'v', 't', 'pct')}) OR ({BLEND('h', 'v')} AND abs(h + v - t) <= 0.05) THEN 'stay'
   WHEN ord AND {near('o[1]', 'o[2]', 0.075, 0.125)} THEN 'ten' WHEN ord AND {near('o[1]', 'o[2]', 0.175, 0.225)} THEN 'twenty' WHEN o[3] > 0.01 THEN 'split' ELSE 'stay' END AS kind FROM m2),
m4 AS (SELECT *, CASE kind WHEN 'typed' THEN {HT('typed_total', 'typed')} WHEN 'split' THEN {HT('o[3]', 'pct')} WHEN 'ten' THEN o[2] WHEN 'twenty' THEN o[2] ELSE h END AS h2,
   CASE kind WHEN 'typed' THEN typed_total WHEN 'split' THEN o[3] WHEN 'ten' THEN o[3] WHEN 'twenty' THEN o[3] ELSE t END AS t2,
   CASE kind WHEN 'zero' THEN 0 WHEN 'typed' THEN typed WHEN 'ten' THEN 10 WHEN 'twenty' THEN 20 ELSE pct END AS p2 FROM m3),
m5 AS (SELECT *, CASE kind WHEN 'typed' THEN t2 - h2 WHEN 'split' THEN t2 - h2 WHEN 'ten' THEN o[1] WHEN 'twenty' THEN o[1] ELSE v END AS v2 FROM m4),
repaired AS (SELECT * EXCLUDE (ht, tva, ttc, pct), CAST(h2 * sgn AS DECIMAL(18,2)) AS ht, CAST(v2 * sgn AS DECIMAL(18,2)) AS tva, CAST(t2 * sgn AS DECIMAL(18,2)) AS ttc0, p2 AS pct, (h2 * sgn <> ht OR v2 * sgn <> tva OR t2 * sgn <> ttc OR p2 <> pct) AS sanitized FROM m5)"""
FILL = lambda t: f"CASE WHEN abs({t}) < 0.01 AND abs(ht) >= 0.01 AND abs(tva) < 0.01 AND pct = 0 THEN ht WHEN abs({t}) < 0.01 AND abs(ht) >= 0.01 AND abs(tva) >= 0.01 AND sign(ht) = sign(tva) AND abs(tva) <= abs(ht) + 0.05 THEN CAST(ht + tva AS DECIMAL(18,2)) ELSE {t} END"
FILLED = f"{REPAIRED}, filled AS (SELECT *, {FILL('ttc0')} AS ttc FROM repaired)"
DBL = "CAST(ht AS DOUBLE) AS ht, CAST(tva AS DOUBLE) AS tva, CAST(ttc AS DOUBLE) AS ttc"
KEYED = f"keyed AS (SELECT *, {key_sql('lib_frss')} AS key FROM {{}})"


def mode(source: str, keys: str, value: str, name: str) -> str:
    return f"(SELECT {keys}, arg_max(v, (n, v)) AS {name} FROM (SELECT {keys}, {value} AS v, count(*) AS n FROM {source} WHERE {value} <> '' GROUP BY ALL) GROUP BY {keys})"


def completed(source: str) -> str:
    """Common table expressions up to ``completed``: identifiers filled by supplier within the dossier."""
    return f"""{KEYED.format(source)},
w1 AS (SELECT keyed.*, k_ice, k_if, CASE WHEN ice_frs <> '' THEN ice_frs ELSE coalesce(k_ice, '') END AS ice2 FROM keyed LEFT JOIN {mode('keyed', 'dossier, key', 'ice_frs', 'k_ice')} USING (dossier, key) LEFT JOIN {mode('keyed', 'dossier, key', 'if_number', 'k_if')} USING (dossier, key)),
w2 AS (SELECT w1.*, i_if FROM w1 LEFT JOIN (SELECT dossier, ice_frs AS ice2, i_if FROM {mode("(SELECT * FROM keyed WHERE ice_frs <> '')", 'dossier, ice_frs', 'if_number', 'i_if')}) USING (dossier, ice2)),
completed AS (SELECT * REPLACE (ice2 AS ice_frs, CASE WHEN if_number = '' THEN coalesce(i_if, k_if, '') ELSE if_number END AS if_number), ice_frs = '' AND k_ice IS NOT NULL AS ice_inferred, if_number = '' AND coalesce(i_if, k_if) IS NOT NULL AS if_inferred FROM w2)"""


def signed_lines(source: str) -> str:
    tail = "|| '|' || pct || '|' || CAST(round(ttc * 100) AS BIGINT)"
    return f"""sigs AS (SELECT dossier, pos, unnest(list_filter(['supplier|' || key || '|' || lower(fact_num) {tail}, CASE WHEN source_id <> '' THEN 'source|' || source_id || '|' || lower(fact_num) {tail} END, 'file|' || lower(source_file) || '|' || lower(fact_num) {tail}, 'day|' || lower(source_file) || '|' || date_fac {tail}], lambda x: x IS NOT NULL)) AS sig FROM {source}),
later AS (SELECT DISTINCT dossier, pos FROM (SELECT dossier, pos, min(pos) OVER (PARTITION BY dossier, sig) AS first FROM sigs) WHERE pos > first),
marked AS (SELECT s.*, l.pos IS NOT NULL AS duplicate FROM {source} s LEFT JOIN later l ON s.dossier = l.dossier AND s.pos = l.pos)"""


PLAUSIBLE = "(length(lib_frss) BETWEEN 4 AND 60 AND length(regexp_replace(lib_frss, '[^\\p{L}]', '', 'g')) >= 4 AND length(regexp_replace(lib_frss, '[^0-9]', '', 'g')) * 4 <= length(lib_frss) AND regexp_matches(lower(lib_frss), '[aeiouyàâéèêîôûü]'))"
#: Rules of each field in order; ``poor``, ``free``, ``issue``, ``implied`` and ``code`` are columns of ``judged``.
AMOUNT_RULES = [("issue IS NOT NULL", "error", None), ("sanitized", "warn", "repaired")]
FIELDS = {
    "fact_num": [("duplicate", "warn", "duplicate"), ("poor", "warn", "poor scan")],
    "lib_frss": [("from_folder", "warn", "from folder"), (f"NOT {PLAUSIBLE}", "warn", "implausible"), ("poor", "warn", "poor scan")],
    "ice_frs": [("ice_frs = ''", "error", "missing"), ("ice_frs = lpad(CAST(client + 1 AS VARCHAR), 15, '0')", "error", "client"), ("ice_inferred", "warn", "inferred"), ("poor", "warn", "poor scan")],
    "if": [("if_number = ''", "warn", "missing"), ("if_inferred", "warn", "inferred")],
    "designation": [("code IS NULL AND pct = 0 AND free AND NOT poor", "ok", "zero rate"), ("code IS NULL AND pct = 0 AND free", "warn", "confirm zero rate"), ("code IS NULL AND pct = 0", "warn", "zero rate without code"), ("code IS NULL", "warn", "no code")],
    "m_ht": [*AMOUNT_RULES, ("free AND poor", "ok", "zero rate"), ("poor", "warn", "poor scan")],
    "tva": [*AMOUNT_RULES, ("tva_calculated AND free AND NOT poor", "ok", "zero rate"), ("tva_calculated AND free", "warn", "confirm zero rate"), ("tva_calculated", "warn", "computed"), ("free AND poor", "warn", "confirm zero rate"), ("poor", "warn", "poor scan")],
    "m_ttc": [*AMOUNT_RULES, ("reconstructed AND free AND NOT poor", "ok", "zero rate"), ("reconstructed", "warn", "computed"), ("free AND poor", "ok", "zero rate"), ("poor", "warn", "poor scan"), ("duplicate", "warn", "duplicate")],
    "taux": [("pct = 0 AND abs(tva) > 0.05", "error", "vat at zero rate"), (f"{BLEND('ht', 'tva')} AND abs(abs(ht) + abs(tva) - abs(ttc)) <= 0.05", "warn", "blended"), ("implied <> pct AND abs(tva) >= 0.05", "warn", "rate"), ("poor AND free", "warn", "confirm zero rate"), ("poor", "warn", "poor scan")],
    "date_fac": [("date_fac IS NULL", "warn", "missing"), ("poor", "warn", "poor scan")],
    "date_paie": [("date_paie IS NULL", "warn", "missing")],
}
CODES = "codes(d, p, code) AS (VALUES ('MATIERES CONSOMMABLES', 20, 146), ('MATIERES CONSOMMABLES', 10, 150), ('PRESTATIONS', 20, 140), ('TELEPHONIE', 20, 140), ('FRAIS BANCAIRE', 10, 142))"
JUDGED = f"""{FILLED}, {completed('(SELECT *, ttc <> ttc0 AS reconstructed FROM filled)')}, {signed_lines('completed')}, {CODES},
judged AS (SELECT marked.*, code, engine = 'ai' AND contains(lower(warnings), 'scan difficile') AS poor, pct = 0 AND abs(ht) >= 0.01 AND abs(tva) <= 0.05 AND abs(abs(ht) - abs(ttc)) <= 0.05 AS free,
  CASE WHEN abs(ht) < 0.01 AND abs(ttc) < 0.01 THEN 'zero' WHEN greatest(ht, tva, ttc) >= 0.01 AND least(ht, tva, ttc) <= -0.01 THEN 'sign' WHEN abs(ht) >= 0.01 AND abs(tva) > abs(ht) + 0.05 THEN 'vat above ht' WHEN abs(abs(ht) + abs(tva) - abs(ttc)) > 0.05 THEN 'sum' END AS issue,
  CASE WHEN abs(ht) < 0.01 THEN NULL WHEN abs(tva) < 0.05 THEN 0 WHEN {near('tva', 'ht', 0.075, 0.125)} THEN 10 WHEN {near('tva', 'ht', 0.175, 0.225)} THEN 20 END AS implied
  FROM marked LEFT JOIN codes ON d = designation AND p = pct)"""
CONF = f"""{JUDGED},
conf AS (SELECT dossier, pos, verified, duplicate, dismissed, fact_num, lib_frss, date_paie, designation, unnest([{', '.join("{'field': '" + f + "', 'c': " + f"CASE WHEN list_contains(verified, '{f}') THEN " + "{'level': 'ok', 'reason': 'verified'} " + ' '.join(f"WHEN {t} THEN {{'level': '{lv}', 'reason': {'issue' if why is None else chr(39) + why + chr(39)}}}" for t, lv, why in rules) + " ELSE {'level': 'ok', 'reason': ''} END}" for f, rules in FIELDS.items())}], recursive := true) FROM judged)"""
CHECKED = "list_contains(verified, '__line_review__')"
HARD = "(level = 'error' OR (level = 'warn' AND field NOT IN ('date_paie', 'if')))"
ANOMALY = f"bool_or(NOT {CHECKED} AND ((duplicate AND NOT dismissed) OR {HARD}))"

ORACLES = {
    "c01_credit_signs": f"WITH {CREDIT} SELECT dossier, pos, {', '.join(f'CAST(CASE WHEN credit AND {c} > 0 THEN -{c} ELSE {c} END AS DOUBLE) AS {c}' for c in ('ht', 'tva', 'ttc'))} FROM credited",
    "c04_repair": f"WITH {REPAIRED} SELECT dossier, pos, CAST(ht AS DOUBLE) AS ht, CAST(tva AS DOUBLE) AS tva, CAST(ttc0 AS DOUBLE) AS ttc, pct, sanitized FROM repaired",
    "c05_fill_total": f"WITH {CREDIT} SELECT dossier, pos, CAST({FILL('ttc')} AS DOUBLE) AS ttc FROM credited",
    "c06_coherent": f"WITH {CREDIT} SELECT dossier, pos, {COHERENT} AS coherent FROM credited",
    "c07_blended": f"WITH {CREDIT} SELECT dossier, source_file, min(pos) AS pos, arg_min(fact_num, pos) AS fact_num FROM credited WHERE {BLEND('ht', 'tva')} GROUP BY dossier, source_file",
    "c11_recompute": f"WITH {D.LINES}, r AS (SELECT *, CAST(round(ht * CAST(CASE pct WHEN 10 THEN 0.10 WHEN 20 THEN 0.20 ELSE 0.00 END AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS v FROM lines) SELECT dossier, pos, CAST(v AS DOUBLE) AS tva, CAST(ht + v AS DOUBLE) AS ttc FROM r",
    "c12_fee_lines": f"WITH {D.LINES}, {D.PAYMENTS}, f AS (SELECT *, -amount AS total FROM payments WHERE regexp_matches(label, 'commission|tenue', 'i') AND amount < 0), g AS (SELECT *, {HT('total', '10')} AS h FROM f) SELECT dossier, txn, 'FRAIS-' || date AS fact_num, CAST(h AS DOUBLE) AS ht, CAST(total - h AS DOUBLE) AS tva, CAST(total AS DOUBLE) AS ttc FROM g",
    "c13_bulk_replace": f"WITH {D.LINES} SELECT dossier, pos, CASE WHEN ice_frs <> '' AND CAST(nullif(ice_frs, '') AS BIGINT) % 3 = 0 THEN lpad(CAST(CAST(nullif(ice_frs, '') AS BIGINT) + 5000 AS VARCHAR), 15, '0') ELSE ice_frs END AS ice_frs, coalesce(ice_frs <> '' AND CAST(nullif(ice_frs, '') AS BIGINT) % 3 = 0, false) AS changed FROM lines",
    "c14_supplier_fill": f"WITH {D.LINES}, {KEYED.format('lines')} SELECT dossier, pos, CASE WHEN if_number = '' THEN '9' || right(key, 3) ELSE if_number END AS if_number FROM keyed",
    "c16_apply_payment": f"WITH {D.LINES}, {D.PAYMENTS}, paid AS (SELECT dossier, 'F' || substr(txn, 2) AS fact_num, date AS paid_on FROM payments WHERE amount < 0) SELECT dossier, pos, CAST(coalesce(paid_on, date_paie) AS VARCHAR) AS date_paie, CASE WHEN paid_on IS NOT NULL THEN 4 END AS id_paie, paid_on IS NOT NULL AS from_bank FROM lines LEFT JOIN paid USING (dossier, fact_num)",
    "c17_status": f"WITH {D.LINES}, p AS (SELECT DISTINCT (o_custkey // 300) * 1000 + (year(o_orderdate) - 1990) * 12 + month(o_orderdate) AS dossier FROM orders), c AS (SELECT dossier, count(*) AS n FROM lines GROUP BY dossier) SELECT dossier, coalesce(n, 0) AS n, CASE WHEN dossier % 5 = 0 THEN 'exported' WHEN n > 0 THEN 'in_review' ELSE 'draft' END AS status FROM p LEFT JOIN c USING (dossier)",
    "f02_most_common_name": f"WITH {D.LINES} SELECT * FROM {mode(chr(40) + 'SELECT * FROM lines WHERE ice_frs <> ' + chr(39) * 2 + ')', 'ice_frs', 'lib_frss', 'name')}",
    "f03_best_ice": f"WITH {D.LINES}, {KEYED.format('lines')} SELECT * FROM {mode('(SELECT * FROM keyed WHERE ice_frs <> lpad(CAST(client + 1 AS VARCHAR), 15, ' + chr(39) + '0' + chr(39) + '))', 'client, key', 'ice_frs', 'best_ice')}",
    "f04_canonical_name": f"WITH {D.LINES}, {KEYED.format('lines')}, c AS (SELECT key, lib_frss, count(*) AS n FROM keyed GROUP BY ALL) SELECT key, arg_max(lib_frss, (n, length(lib_frss), lib_frss)) AS name FROM c GROUP BY key",
    "f05_first_identifier": f"WITH {D.LINES}, {KEYED.format('lines')} SELECT dossier, key, arg_min(if_number, pos) AS if_number FROM keyed WHERE if_number <> '' GROUP BY dossier, key",
    "f06_complete_identifiers": f"WITH {D.LINES}, {completed('lines')} SELECT dossier, pos, ice_frs, if_number, ice_inferred, if_inferred FROM completed",
    "f07_normalise_groups": f"WITH {D.LINES}, l AS (SELECT * REPLACE (CASE WHEN pos % 8 = 3 THEN '' ELSE lib_frss END AS lib_frss), {key_sql('CASE WHEN pos % 8 = 3 THEN NULL ELSE lib_frss END')} AS key, regexp_extract(source_file, 'Supplier#0*([0-9]+)', 1) AS sup FROM lines), g AS (SELECT *, CASE WHEN sup <> '' THEN 'folder:factures' WHEN key <> '' THEN 'supplier:' || key ELSE 'unknown' END AS grp FROM l), h AS (SELECT dossier, grp, arg_min(sup, pos) AS hint FROM g GROUP BY ALL) SELECT g.dossier, g.pos, g.grp AS \"group\", CASE WHEN ice_frs = '' THEN coalesce(b, '') ELSE ice_frs END AS ice_frs, CASE WHEN if_number = '' THEN coalesce(f, '') ELSE if_number END AS if_number, CASE WHEN lib_frss <> '' THEN lib_frss WHEN hint <> '' THEN 'Maison Du Riad ' || hint ELSE coalesce(n, '') END AS lib_frss, from_folder OR (lib_frss = '' AND hint <> '') AS from_folder FROM g JOIN h USING (dossier, grp) LEFT JOIN {mode('g', 'dossier, grp', 'ice_frs', 'b')} USING (dossier, grp) LEFT JOIN {mode('g', 'dossier, grp', 'if_number', 'f')} USING (dossier, grp) LEFT JOIN {mode('g', 'dossier, grp', 'lib_frss', 'n')} USING (dossier, grp)",
    "f08_consolidate": f"WITH {D.LINES}, w AS (SELECT *, count(*) OVER k AS n, bool_or(abs(tva) < 0.01) OVER k AS z, bool_or(abs(tva) >= 0.01) OVER k AS s, min(pos) OVER k AS first, CAST(sum(ht) OVER k AS DECIMAL(18,2)) AS sh, CAST(sum(ttc) OVER k AS DECIMAL(18,2)) AS st, CAST(sum(tva) OVER k AS DECIMAL(18,2)) AS sv, bool_or(ht < 0) OVER k AS neg, bool_or(abs(ttc) <= abs(ht)) OVER k AS flat FROM lines WINDOW k AS (PARTITION BY dossier, source_file, fact_num, pct)), x AS (SELECT *, n > 1 AND z AND s AS merged, CASE WHEN abs(sh) > 0 THEN round(abs(sh) * CAST(CASE pct WHEN 10 THEN 0.10 WHEN 20 THEN 0.20 ELSE 0.00 END AS DECIMAL(3,2)), 2) * CASE WHEN sh < 0 OR neg THEN -1 ELSE 1 END ELSE sv END AS v FROM w) SELECT dossier, pos, CAST(CASE WHEN merged THEN sh ELSE ht END AS DOUBLE) AS ht, CAST(CASE WHEN merged THEN v ELSE tva END AS DOUBLE) AS tva, CAST(CASE WHEN merged THEN CASE WHEN abs(sh) > 0 AND (abs(st) <= abs(sh) OR flat) THEN sh + v ELSE st END ELSE ttc END AS DOUBLE) AS ttc, merged FROM x WHERE NOT merged OR pos = first",
    "g01_duplicates": f"WITH {D.LINES}, {KEYED.format('lines')}, {signed_lines('keyed')} SELECT dossier, pos, duplicate FROM marked",
    "g02_remove_duplicates": f"WITH {D.LINES}, {KEYED.format('lines')}, {signed_lines('keyed')} SELECT dossier, pos, fact_num FROM marked WHERE NOT duplicate",
    "g03_merge": f"WITH {D.LINES}, o AS (SELECT *, CASE WHEN copy = 0 AND pos % 2 = 0 THEN 0 ELSE 1 END AS origin, CASE WHEN source_id <> '' THEN source_id WHEN contains(source_file, '/') THEN lower(string_split(source_file, '/')[-2] || '/' || string_split(source_file, '/')[-1]) ELSE lower(source_file) END || '|' || lower(fact_num) || '|' || pct AS k FROM lines), r AS (SELECT *, row_number() OVER (PARTITION BY dossier, k ORDER BY origin, pos) AS n FROM o) SELECT dossier, pos, origin FROM r WHERE origin = 0 OR n = 1",
    "j01_confidence": f"WITH {CONF} SELECT dossier, pos, field, level, reason FROM conf",
    "j03_anomalies": f"WITH {CONF} SELECT dossier, pos, {ANOMALY} AS anomaly, bool_or(duplicate OR level <> 'ok') AS review FROM conf GROUP BY dossier, pos",
    "j04_issue_summary": f"WITH {CONF}, i AS (SELECT dossier, pos, field, level, {CHECKED} AS checked FROM conf UNION ALL SELECT DISTINCT dossier, pos, 'duplicate', CASE WHEN duplicate AND NOT dismissed THEN 'warn' ELSE 'ok' END, {CHECKED} FROM conf) SELECT dossier, pos, coalesce(string_agg(field, ',' ORDER BY field) FILTER (level = 'error' AND NOT checked), '') AS errors, coalesce(string_agg(field, ',' ORDER BY field) FILTER (level = 'warn' AND {HARD} AND NOT checked), '') AS warns FROM i GROUP BY dossier, pos",
    "j05_review_list": f"WITH {CONF}, i AS (SELECT dossier, fact_num, lib_frss, field, level, reason FROM conf WHERE NOT {CHECKED} AND level <> 'ok' UNION SELECT dossier, fact_num, lib_frss, 'duplicate', 'warn', 'duplicate' FROM conf WHERE NOT {CHECKED} AND duplicate AND NOT dismissed) SELECT DISTINCT dossier, CASE WHEN level = 'error' THEN 0 ELSE 1 END AS rank, 'Facture ' || fact_num || ' (' || lib_frss || ')' AS label, field, level, reason FROM i",
    "c15_review_marks": f"WITH {D.LINES}, {KEYED.format('lines')}, {signed_lines('keyed')}, a AS (SELECT *, CASE WHEN ht > 50000 AND NOT {CHECKED} THEN list_append(verified, '__line_review__') ELSE verified END AS v1, dismissed OR (ht > 50000 AND duplicate) AS d1 FROM marked), b AS (SELECT *, CASE WHEN pct = 10 THEN list_distinct(list_append(list_filter(v1, lambda x: x <> '__line_review__'), 'ice_frs')) ELSE v1 END AS v2, d1 AND pct <> 10 AS d2 FROM a) SELECT dossier, pos, array_to_string(list_sort(CASE WHEN ttc = 0 THEN list_filter(v2, lambda x: x <> '__line_review__') ELSE v2 END), ',') AS marks, d2 AND ttc <> 0 AS dismissed, ice_frs = '' AND pct <> 10 AS ice_inferred FROM b",
    "c18_stored": f"WITH {CONF}, c AS (SELECT dossier, pos, string_agg(field || ':' || level || ':' || reason, ',' ORDER BY field || ':' || level || ':' || reason) AS field_confidence FROM conf GROUP BY ALL) SELECT source_file, source_id, fact_num, designation, CAST(ht AS DOUBLE) AS m_ht, CAST(tva AS DOUBLE) AS tva, CAST(ttc AS DOUBLE) AS m_ttc, if_number AS if, lib_frss, ice_frs, ice_inferred, if_inferred, reconstructed AS ttc_reconstructed, tva_calculated, sanitized AS amounts_sanitized, from_folder AS supplier_from_folder, false AS date_paie_from_bank, engine AS extraction_engine, array_to_string(verified, ',') AS user_verified_fields, field_confidence, pct / 100.0 AS taux, CAST(NULL AS INTEGER) AS id_paie, coalesce(CAST(date_paie AS VARCHAR), '') AS date_paie, coalesce(CAST(date_fac AS VARCHAR), '') AS date_fac FROM judged JOIN c USING (dossier, pos)",
    "f14_anomaly_count": f"WITH {CONF}, a AS (SELECT dossier, pos, any_value(date_paie) AS paid, any_value(designation) AS d, {ANOMALY} AS anomaly FROM conf GROUP BY dossier, pos) SELECT dossier, count(*) AS n, count(*) FILTER (anomaly) AS anomalies, count(*) FILTER (paid IS NULL AND d <> 'FRAIS BANCAIRE') AS unpaid FROM a GROUP BY dossier",
    "f26_issue_counts": f"WITH {CONF} SELECT dossier, field, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warn') AS warns FROM conf GROUP BY dossier, field",
    "declaration": f"WITH {FILLED}, codes(d, p, code) AS (VALUES ('MATIERES CONSOMMABLES', 20, 146), ('MATIERES CONSOMMABLES', 10, 150), ('PRESTATIONS', 20, 140), ('TELEPHONIE', 20, 140), ('FRAIS BANCAIRE', 10, 142)), s AS (SELECT client, period, designation, pct, count(*) AS n, CAST(sum(ht) AS DOUBLE) AS ht, CAST(sum(tva) AS DOUBLE) AS tva, CAST(sum(ttc) AS DOUBLE) AS ttc FROM filled GROUP BY ALL) SELECT s.*, code FROM s LEFT JOIN codes ON d = designation AND p = pct",
    "a12_declaration_rows": f"WITH {FILLED}, codes(d, p, code) AS (VALUES ('MATIERES CONSOMMABLES', 20, 146), ('MATIERES CONSOMMABLES', 10, 150), ('PRESTATIONS', 20, 140), ('TELEPHONIE', 20, 140), ('FRAIS BANCAIRE', 10, 142)) SELECT dossier, pos AS or_, fact_num, designation, CAST(ht AS DOUBLE) AS m_ht, CAST(tva AS DOUBLE) AS tva, CAST(ttc AS DOUBLE) AS m_ttc, if_number AS if_frs, lib_frss, ice_frs, CAST(pct / 100.0 AS DOUBLE) AS taux, 4 AS id_paie, CAST(datediff('day', DATE '1899-12-30', date_paie) AS INTEGER) AS date_paie, CAST(datediff('day', DATE '1899-12-30', date_fac) AS INTEGER) AS date_fac, code AS code_tva FROM filled LEFT JOIN codes ON d = designation AND p = pct",
}
