"""Streams that stop and start again, and timers of jobs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import lines as L
from ledgerloom.streaming import jobs as J
from ledgerloom.streaming import store as ST

LINES = "dossier long, pos long, source_file string, source_id string, fact_num string, pct int"


def rows_of(epoch):
    """Lines of one epoch: some new, some that the ledger or an earlier epoch has."""
    return [(d, 100 * epoch + i, f"f{d}.pdf", f"s{d}", f"N{(epoch * 3 + i) % 11}", 20) for d in range(40) if (d + epoch) % 2 for i in range(6)]


def expected(epochs):
    have = {}
    for e in range(epochs):
        for d, pos, _, _, number, _ in rows_of(e):
            have.setdefault((d, number), pos)
    return sorted((d, pos, n) for (d, n), pos in have.items())


def count(df):
    return df.groupBy("dossier").agg(F.count("*").alias("n"), F.sum("pos").alias("positions"))


def source(spark, path, epochs):
    for e in range(epochs):
        spark.createDataFrame(rows_of(e), LINES).coalesce(1).write.mode("ignore").parquet(f"{path}/in/{e}")
    return spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")


def store(spark, path):
    return ST.Ledgers(spark, f"{path}/store", {"lines": spark.createDataFrame([], LINES).schema, "counts": count(spark.createDataFrame([], LINES)).schema}, buckets=5)


def start(spark, path, write):
    return source(spark, path, 4).writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


@pytest.mark.parametrize("moment", ["before", "after"])
def test_a_killed_import_starts_again(spark, tmp_path, moment):
    """A query dies in its second epoch, before or after its commit; a new process with a new store takes over from the checkpoint."""
    path, merge = str(tmp_path), lambda a, b: L.merge_lines(a, b).drop("origin")
    put = ST.merging(store(spark, path), "import", merge, count=count)

    def dies(batch, epoch):
        if epoch == 1 and moment == "before":
            raise RuntimeError("killed")
        put(batch, epoch)
        if epoch == 1:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        start(spark, path, dies).awaitTermination()
    second = store(spark, path)
    assert second.committed("import", 1) == (moment == "after")
    start(spark, path, ST.merging(second, "import", merge, count=count)).awaitTermination()
    want = expected(4)
    assert sorted((r.dossier, r.pos, r.fact_num) for r in second.read("lines").collect()) == want
    sums = {}
    for d, pos, _ in want:
        n, s = sums.get(d, (0, 0))
        sums[d] = (n + 1, s + pos)
    assert {r.dossier: (r.n, r.positions) for r in second.read("counts").collect()} == sums
    # an epoch sent again, and a batch without rows, change nothing
    version = second.manifest()["version"]
    ST.merging(second, "import", merge, count=count)(spark.createDataFrame(rows_of(0), LINES), 3)
    ST.merging(second, "import", merge, count=count)(spark.createDataFrame([], LINES), 9)
    assert second.manifest()["version"] == version


def test_only_touched_buckets_are_written_and_writers_collide(spark, tmp_path):
    s = store(spark, str(tmp_path))
    assert s.read("lines").count() == 0
    s.commit("a", 0, list(range(5)), {"lines": spark.createDataFrame(rows_of(0), LINES)})
    before = s.manifest()["folders"]["lines"]
    one = spark.createDataFrame([(1, 999, "f", "s", "N", 20)], LINES)
    ST.merging(s, "b", lambda a, b: a.unionByName(b))(one, 0)
    after = s.manifest()["folders"]["lines"]
    assert len([b for b in after if after[b] != before.get(b)]) == 1 and s.read("lines").count() == len(rows_of(0)) + 1
    with pytest.raises(RuntimeError):
        s._publish(1, {})


JOBS = "job long, status string, total int, touched_at timestamp"


def test_stale_jobs_by_timer(spark, tmp_path):
    at = lambda h, m, s=0: datetime(2026, 1, 1, h, m, s)
    batches = [
        [(1, "processing", 3, at(10, 0)), (2, "processing", 3, at(10, 0)), (5, "uploading", 0, at(10, 0)), (6, "uploading", 4, at(10, 0)), (7, "queued", 1, at(10, 0))],
        [(2, "done", 3, at(10, 5)), (3, "processing", 1, at(10, 6)), (6, "uploading", 5, at(10, 1))],
        [(3, "processing", 1, at(10, 20)), (1, "processing", 3, at(9, 59)), (4, "processing", 1, at(11, 0))],
        [(4, "processing", 1, at(11, 0, 30)), (9, "done", 0, at(11, 10))],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, JOBS).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(JOBS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.STORE)
    try:
        q = J.stale_jobs(stream).writeStream.format("memory").queryName("stale").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    told = sorted((r.job, r.status, r.next) for r in spark.table("stale").collect())
    assert told == [(1, "processing", "queued"), (3, "processing", "queued"), (5, "uploading", "failed"), (6, "uploading", "queued")]


def run_stale(spark, path, batches, name, **kw):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, JOBS).coalesce(1).write.parquet(f"{path}/in/{k}")
    stream = spark.readStream.schema(JOBS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.STORE)
    try:
        q = J.stale_jobs(stream, **kw).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return q, sorted((r.job, r.status, r.next) for r in spark.table(name).collect())


def test_jobs_behind_the_clock_are_told(spark, tmp_path):
    """The clock's row comes in a batch before theirs, and does not move again."""
    at = lambda h, m: datetime(2026, 1, 1, h, m)
    signs = [(1, "processing", 3, at(10, 0)), (2, "uploading", 0, at(10, 0)), (3, "uploading", 2, at(10, 0)), (4, "processing", 1, at(11, 5)), (5, "done", 1, at(10, 0)), (None, "processing", 1, at(10, 0)), (6, "processing", None, at(10, 0)), (6, "done", None, at(10, 2))]
    _, told = run_stale(spark, tmp_path, [[(9, "done", 0, at(11, 10))], signs], "behind")
    assert told == [(1, "processing", "queued"), (2, "uploading", "failed"), (3, "uploading", "queued")]


def test_timers_are_kept_by_bucket(spark, tmp_path):
    """Calls to the state store grow with the buckets, not with the jobs."""
    at = lambda h, m: datetime(2026, 1, 1, h, m)
    jobs = [(i, ("processing", "uploading", "queued")[i % 3], i % 2, at(10, i % 7)) for i in range(3000)]
    q, told = run_stale(spark, tmp_path, [jobs[:1500], jobs[1500:], [(9999, "done", 0, at(13, 0))]], "buckets", buckets=8)
    assert told == sorted((i, s, "failed" if s == "uploading" and not n else "queued") for i, s, n, _ in jobs if s != "queued")
    timers = [o["customMetrics"]["numRegisteredTimers"] for p in q.recentProgress for o in p["stateOperators"]]
    assert 0 < sum(timers) <= 8 * len(timers)
