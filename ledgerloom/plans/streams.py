"""Streaming queries: the derived tables are replayed as streams of files, and the final state is returned."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import amounts as A
from ledgerloom.functions.lineage import cut
from ledgerloom.operators import lines as L
from ledgerloom.plans.files import _folder
from ledgerloom.plans.lines import COHERENT
from ledgerloom.plans.portfolio import ORACLES as PORTFOLIO
from ledgerloom.plans.portfolio import as_of
from ledgerloom.sources import driver_tables as D
from ledgerloom.streaming import jobs as J
from ledgerloom.streaming import store as ST


def _replay(df: DataFrame, files: int = 4, path: str | None = None) -> DataFrame:
    """Write a table as files and open them as a stream."""
    spark, path = df.sparkSession, path or _folder(df.sparkSession)
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


def _settle(stream: DataFrame, mode: str, later: Callable[[], None] | None = None) -> DataFrame:
    """Run a stream over what is there, and over what ``later`` adds; every trigger writes to a table of its own, in the shared folder."""
    spark, path = stream.sparkSession, _folder(stream.sparkSession)

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")

    def run() -> None:
        query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").queryName(f"q{uuid.uuid4().hex}").trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    if later:
        later()
        run()
    schema = T.StructType([*stream.schema.fields, T.StructField("epoch", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{path}/out/epoch=*")


def k05_half_months(spark, sf_dir):
    """Totals of each half-month as the order stream leaves them: the last update of each."""
    orders = D.platform_orders(spark, sf_dir).withColumn("created_at", F.col("created_at").cast("timestamp"))
    out = _settle(J.half_month_totals(_replay(orders), "20000 days"), "update")
    return out.groupBy("month", "half").agg(*[F.max_by(c, "epoch").cast("double").alias(c) for c in ("orders", "collected", "fees")])


def k03_first_files(spark, sf_dir):
    """Source ids taken in once from the document stream."""
    docs = D.documents(spark, sf_dir).where("source_id <> ''").withColumn("created_at", F.col("created_at").cast("timestamp"))
    return _settle(J.first_of_each(_replay(docs.select("id", "source_id", "created_at")), "20000 days"), "append").groupBy("source_id").agg(F.count("*").alias("n"))


LEDGER = ["dossier", "pos", "source_file", "source_id", "fact_num", "pct"]


def _merged(old: DataFrame, new: DataFrame) -> DataFrame:
    return L.merge_lines(old, new).drop("origin")


def _ledgers(spark, old: DataFrame, count=None) -> ST.Ledgers:
    """A store that holds these lines, and their counts, as first version."""
    tables = {"lines": old.schema} | ({"counts": count(old).schema} if count else {})
    store = ST.Ledgers(spark, _folder(spark), tables)
    store.commit("start", 0, list(range(store.buckets)), {"lines": old} | ({"counts": count(old)} if count else {}))
    return store


def k01_import(spark, sf_dir):
    """Ledgers after new lines arrived as a stream: the same as merging them at once, up to which copy came first."""
    lines = D.invoice_lines(spark, sf_dir).select(*LEDGER)
    store = _ledgers(spark, lines.where("pos % 2 = 0"))
    query = _replay(lines.where("pos % 2 = 1")).writeStream.foreachBatch(ST.merging(store, "import", _merged))
    query.option("checkpointLocation", f"{store.path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return store.read("lines").groupBy("dossier").agg(F.count("*").alias("n"), F.countDistinct(L.merge_key()).alias("keys"))


def k04_recount(spark, sf_dir):
    """Lines and incoherent lines of each ledger, kept up to date while new lines arrive; a dossier's new lines come in one file."""
    lines = cut(D.invoice_lines(spark, sf_dir).select(*LEDGER, "ht", "tva", "ttc"))  # read for the ledger, its counts and the stream

    def count(df: DataFrame) -> DataFrame:
        return df.groupBy("dossier").agg(F.count("*").alias("n"), F.count_if(~A.coherent(F.col("ht"), F.col("tva"), F.col("ttc"), F.col("pct"))).alias("anomalies"))

    store = _ledgers(spark, lines.where("pos % 2 = 0"), count)
    new = lines.where("pos % 2 = 1")
    # a batch has whole buckets, so that none is written again by the next
    new.repartition(4, store.bucket()).write.parquet(f"{store.path}/new")
    stream = spark.readStream.schema(new.schema).option("maxFilesPerTrigger", 1).parquet(f"{store.path}/new")
    query = stream.writeStream.foreachBatch(ST.merging(store, "import", _merged, count=count))
    query.option("checkpointLocation", f"{store.path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return store.read("counts")


#: Jobs that are watched in one bucket of a stream, about.
BUCKET = 4096


def k02_stale_stream(spark, sf_dir):
    """Next state of every job as the stream of signs of life tells it once the clock stands at the given moment."""
    days = 20_000  # replayed files are in no order of time, so that none of their rows may be late
    jobs = D.import_jobs(spark, sf_dir).select("job", "status", "total", F.col("touched_at").cast("timestamp").alias("touched_at"))
    clock = spark.range(1).select(F.lit(-1).cast("long").alias("job"), F.lit("done").alias("status"), F.lit(0).alias("total"), F.date_add(as_of(), days).cast("timestamp").alias("touched_at"))
    path = _folder(spark)
    stream = _replay(jobs, path=path)
    buckets = max(64, spark.read.schema(jobs.schema).parquet(path).count() // BUCKET)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.STORE)
    try:
        # the clock comes after all jobs, so that none is behind it
        told = _settle(J.stale_jobs(stream, f"{days} days", buckets), "append", later=lambda: clock.write.mode("append").parquet(path))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return jobs.join(told.select("job", "next"), "job", "left").select("job", "status", F.coalesce("next", "status").alias("next"))


QUERIES = {f.__name__: f for f in (k01_import, k02_stale_stream, k04_recount, k03_first_files, k05_half_months)}
KEY = "CASE WHEN source_id <> '' THEN source_id WHEN contains(source_file, '/') THEN lower(string_split(source_file, '/')[-2] || '/' || string_split(source_file, '/')[-1]) ELSE lower(source_file) END || '|' || lower(fact_num) || '|' || pct"
ORACLES = {
    "k01_import": f"WITH {D.LINES}, o AS (SELECT dossier, pos, CASE WHEN pos % 2 = 0 THEN 0 ELSE 1 END AS origin, {KEY} AS k FROM lines), r AS (SELECT *, row_number() OVER (PARTITION BY dossier, k ORDER BY origin, pos) AS n FROM o) SELECT dossier, count(*) AS n, count(DISTINCT k) AS keys FROM r WHERE origin = 0 OR n = 1 GROUP BY dossier",
    "k02_stale_stream": PORTFOLIO["k02_sweep"],
    "k04_recount": f"WITH {D.LINES}, o AS (SELECT *, CASE WHEN pos % 2 = 0 THEN 0 ELSE 1 END AS origin, {KEY} AS k FROM lines), r AS (SELECT *, row_number() OVER (PARTITION BY dossier, k ORDER BY origin, pos) AS n FROM o) SELECT dossier, count(*) AS n, count(*) FILTER (NOT {COHERENT}) AS anomalies FROM r WHERE origin = 0 OR n = 1 GROUP BY dossier",
    "k03_first_files": f"WITH {D.DOCUMENTS} SELECT source_id, CAST(1 AS BIGINT) AS n FROM docs WHERE source_id <> '' GROUP BY source_id",
    "k05_half_months": f"WITH {D.ORDERS} SELECT month, half, CAST(count(*) AS DOUBLE) AS orders, CAST(sum(CASE WHEN status = 'DELIVERED' THEN amount ELSE 0 END) AS DOUBLE) AS collected, CAST(sum(fee) AS DOUBLE) AS fees FROM porders GROUP BY month, half",
}
