"""Bank statement files (CSV, TXT) as rows, and ledger storage as JSON or declaration files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import scalars as S
from ledgerloom.sources import statements

# Header patterns of each column role, in order of precedence
ROLES = {"date": "DATE|VALEUR|OPERATION", "label": "LIBELL|DESCRIPTION|INTITUL|MOTIF|DETAIL", "debit": "DEBIT", "credit": "CREDIT", "amount": "^MONTANT$|AMOUNT|SOMME"}
LINE = T.StructType([T.StructField("pos", T.LongType()), T.StructField("fact_num", T.StringType()), T.StructField("ttc", T.StringType()), T.StructField("taux", T.StringType())])


def rows(spark: SparkSession, path: str, head: int | None = None) -> DataFrame:
    """Cells of every line below a folder (A1), or of the first ``head`` rows of each file: ``file, offset, row, cells``; the delimiter follows the file's first line."""
    statements.register(spark)
    source = spark.read.format("statement").option("path", path)
    lines = (source if head is None else source.option("head", head)).load()
    return lines.select("file", "offset", "row", F.when(F.col("mark") == ";", F.split("line", ";")).otherwise(F.split("line", ",")).alias("cells"))


#: Rows of a file among which its header is looked for.
HEAD = 15


def headers(head: DataFrame) -> DataFrame:
    """Header row of each file (A2): first of its 15 rows that names a date and a label, debit or amount; else the first row."""
    text = S.fold(F.array_join("cells", " "))
    hit = text.rlike(ROLES["date"]) & (text.rlike(ROLES["label"]) | text.rlike(ROLES["debit"]) | text.rlike(ROLES["amount"]))
    return head.where(F.col("row") < HEAD).groupBy("file").agg(F.coalesce(F.min(F.when(hit, F.col("row"))), F.lit(0)).cast("int").alias("header"))


def roles(head: DataFrame) -> DataFrame:
    """Column of each role (A3): each header cell takes the first role that is free; the label falls back on the first telling cell."""
    at = head.join(headers(head), "file").where("row = header").select("file", "header", F.col("offset").alias("header_offset"), F.posexplode("cells").alias("col", "cell")).withColumn("h", S.fold(F.col("cell")))
    kind = F.coalesce(*[F.when(F.col("h").rlike(p), F.lit(r)) for r, p in ROLES.items()])
    first = at.groupBy("file", "header", "header_offset").agg(*[F.min(F.when(kind == r, F.col("col"))).alias(r) for r in ROLES], F.min(F.when(F.length(F.trim("cell")) > 2, F.col("col"))).alias("fallback"))
    return first.withColumn("label", F.coalesce("label", "fallback")).drop("fallback")


def transactions(spark: SparkSession, path: str) -> DataFrame:
    """Movements of statement files (A4): debit wins, then credit, then the signed amount; rows without date or amount, and balances, go."""
    at = rows(spark, path).join(roles(rows(spark, path, HEAD)), "file").where(F.col("offset") > F.col("header_offset"))
    cell = lambda r: F.get("cells", F.col(r).cast("int"))
    raw = at.select("file", "offset", S.date_bank(cell("date")).alias("date"), F.trim(F.coalesce(cell("label"), F.lit(""))).alias("label"), S.money_bank(cell("debit")).alias("d"), S.money_bank(cell("credit")).alias("c"), S.money_bank(cell("amount")).alias("a"))
    amount = F.when(F.abs("d") > 0, -F.abs("d")).when(F.abs("c") > 0, F.abs("c")).otherwise(F.col("a"))
    label = S.fold(F.col("label"))
    out = raw.withColumn("amount", amount).where((F.col("date") != "") & (F.abs("amount") >= 0.01) & ~label.rlike(S.SKIP_WORDS))
    return out.select("file", "offset", "date", "label", "amount", F.when(label.rlike(S.FEE_WORDS) & (F.col("amount") < 0), "fee").when(F.col("amount") < 0, "payment").otherwise("credit").alias("kind"))


def normalise_json(raw: DataFrame) -> DataFrame:
    """Movements given as JSON arrays (A5): spellings of the fields are accepted, a declared type forces the sign."""
    item = T.StructType([T.StructField(c, T.StringType()) for c in ("date", "label", "libelle", "description", "amount", "montant", "type")])
    x = raw.select("doc", F.posexplode(F.from_json("json", T.ArrayType(item))).alias("pos", "x")).select("doc", "pos", "x.*")
    amount = S.money_bank(F.coalesce("amount", "montant"))
    kind = F.lower(F.coalesce("type", F.lit("")))
    signed = F.when(kind.isin("debit", "payment", "fee"), -F.abs(amount)).when(kind == "credit", F.abs(amount)).otherwise(amount)
    out = x.select("doc", "pos", S.date_bank(F.col("date")).alias("date"), F.coalesce("label", "libelle", "description", F.lit("")).alias("label"), signed.alias("amount"), kind.alias("declared")).where(F.abs("amount") >= 0.01)
    fee = (F.col("declared") == "fee") | (S.fold(F.col("label")).rlike(S.FEE_WORDS) & (F.col("amount") < 0))
    return out.withColumn("kind", F.when(fee, "fee").when(F.col("amount") < 0, "payment").otherwise("credit")).drop("declared")


def explode_ledger(ledgers: DataFrame) -> DataFrame:
    """Lines of ledgers stored as a JSON array (A9), position kept."""
    return ledgers.select("dossier", F.posexplode(F.from_json("lines", T.ArrayType(LINE))).alias("at", "x")).select("dossier", "at", "x.*")


def collect_ledger(lines: DataFrame) -> DataFrame:
    """Ledgers of lines as a JSON array in order of position (A10); a dossier's lines are a few hundred."""
    return lines.groupBy("dossier").agg(F.to_json(F.array_sort(F.collect_list(F.struct("pos", "fact_num", "ttc", "taux")))).alias("lines"))


def upsert_ledgers(old: DataFrame, new: DataFrame) -> DataFrame:
    """Whole-ledger replacement; what the new side does not give stays (A10)."""
    n = new.withColumnRenamed("lines", "__new")
    return old.join(n, "dossier", "full_outer").select("dossier", F.coalesce("__new", "lines").alias("lines"))


def parse_lines(raw: DataFrame) -> DataFrame:
    """Lines of extracted JSON with errors kept (A11): an unknown rate is inferred from the amounts, an unreadable row becomes a warning."""
    item = T.StructType([T.StructField(c, T.StringType()) for c in ("fact_num", "m_ht", "tva", "taux")])
    x = raw.select("doc", F.posexplode(F.from_json("json", T.ArrayType(item))).alias("pos", "x")).select("doc", "pos", "x.*")
    x = x.withColumns({"ht": F.col("m_ht").try_cast("decimal(18,2)"), "vat": F.col("tva").try_cast("decimal(18,2)"), "given": S.rate(F.col("taux").try_cast("double"))})
    return x.select("doc", "pos", "fact_num", F.col("ht").cast("double").alias("ht"), F.col("vat").cast("double").alias("tva"), F.coalesce(F.round(F.col("given") * 100).cast("int"), S.rate_from_amounts(F.col("ht"), F.col("vat"))).alias("pct"), F.when(F.col("ht").isNull(), "unreadable amount").otherwise("").alias("warning"))


def export_names(client: Column, month: Column, year: Column) -> Column:
    """Sheet and file name of a declaration (A13): ``struct<sheet, file>``; what is no letter, digit, dash or underscore becomes one."""
    mm, yyyy = F.lpad(month.cast("string"), 2, "0"), year.cast("string")
    return F.struct(F.concat(F.lit("EDI"), mm, F.substring(yyyy, 3, 2)).alias("sheet"), F.concat(F.regexp_replace(client, r"[^\p{L}\p{N}_-]", "_"), F.lit("_DED_TVA_"), mm, yyyy).alias("file"))


#: Columns of a declaration, in order.
DECLARED = "or_ long, fact_num string, designation string, m_ht double, tva double, m_ttc double, if_frs string, lib_frss string, ice_frs string, taux double, id_paie int, date_paie int, date_fac int, code_tva int"


def write_declaration(rows: DataFrame, name: Column, path: str) -> None:
    """Declaration files (A12): rows of the columns :data:`DECLARED` by the file that ``name`` (A13) gives, in order of ``or_``.

    All files are replaced together; a reader sees the earlier set or this one.
    """
    statements.register(rows.sparkSession)
    columns = [c.split()[0] for c in DECLARED.split(", ")]
    named = rows.withColumn("file_name", name).repartition("file_name").sortWithinPartitions("file_name", "or_").select("file_name", *columns)
    named.write.format("declaration").option("path", path).mode("append").save()


def read_declaration(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the declaration files that count, with the file's name."""
    lines = spark.read.schema(DECLARED).option("header", True).csv(statements.declared_files(path))
    return lines.withColumn("file_name", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.\d+-[0-9a-f]+\.csv$", 1))


def append_activity(rows: DataFrame, path: str) -> None:
    """Append entries to the activity log."""
    rows.write.mode("append").json(path)


def synthetic_lines(spark: SparkSession, count: int, anomaly_every: int) -> DataFrame:
    """Numbered lines, every k-th without a company id."""
    i = F.col("id")
    return spark.range(1, count + 1).select(F.lit(1).cast("long").alias("dossier"), i.alias("pos"), F.concat(F.lit("F"), i.cast("string")).alias("fact_num"), F.when(i % anomaly_every == 0, "").otherwise(F.lpad(i.cast("string"), 15, "1")).alias("ice_frs"))


def payload_bytes(ledgers: DataFrame, summaries: DataFrame) -> DataFrame:
    """Bytes of each stored ledger and of its summary as JSON, and how many times larger the ledger is."""
    size = lambda df, name: df.select("dossier", F.octet_length(F.to_json(F.struct(*df.columns))).alias(name))
    return size(ledgers, "payload_bytes").join(size(summaries, "summary_bytes"), "dossier").withColumn("ratio", F.round(F.col("payload_bytes") / F.col("summary_bytes"), 2))
