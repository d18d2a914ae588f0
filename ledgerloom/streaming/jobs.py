"""Structured Streaming forms of the import jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.functions import scalars as S


def half_month_totals(orders: DataFrame, delay: str = "40 days") -> DataFrame:
    """Running totals of each half-month of an order stream (K5); rows later than the watermark are dropped."""
    return orders.withWatermark("created_at", delay).groupBy("month", "half").agg(F.count("*").alias("orders"), F.sum(F.when(S.delivered(F.col("status")), F.col("amount")).otherwise(0)).alias("collected"), F.sum("fee").alias("fees"))


def first_of_each(files: DataFrame, delay: str = "1 day") -> DataFrame:
    """Files once per source id (K3)."""
    return files.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["source_id"])


#: Seconds without a sign of life after which an upload without files fails, and one with files and a running job queue again; fixed values.
EMPTY_UPLOAD, PARTIAL_UPLOAD, PROCESSING = 300, 90, 1800
#: Milliseconds of event time for which a job that needs no more watching is remembered, so that rows out of order do not revive it.
KEEP = 3_600_000


def outcomes(jobs: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Seconds that each job may stay silent (0: for ever), and what it becomes then."""
    empty, partial, running = (jobs["status"] == "uploading") & (jobs["total"] == 0), (jobs["status"] == "uploading") & (jobs["total"] > 0), jobs["status"] == "processing"
    return np.select([empty, partial, running], [EMPTY_UPLOAD, PARTIAL_UPLOAD, PROCESSING], 0), np.select([empty, partial, running], ["failed", "queued", "queued"], "").astype(object)


#: What is remembered of a job: its newest sign of life, whether it was told, and the event time from which it is told or else forgotten.
WATCHED = pa.schema([("job", pa.int64()), ("status", pa.string()), ("total", pa.int64()), ("millis", pa.int64()), ("told", pa.bool_()), ("wake", pa.int64())])


class StaleJobs(StatefulProcessor):
    """The jobs of a bucket as one Arrow table, and one timer, for the first of them to pass its limit.

    The newest sign of life of a job counts. A job that is due is told, at once
    if the watermark has passed its limit already, remembered for a while and
    then forgotten.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "timer long, jobs binary")

    def _watched(self) -> tuple[int | None, pd.DataFrame]:
        if not self.seen.exists():
            return None, WATCHED.empty_table().to_pandas()
        timer, jobs = self.seen.get()
        return timer, pa.ipc.open_stream(bytes(jobs)).read_all().to_pandas()

    def _told(self, jobs: pd.DataFrame, before: int | None, now: int) -> pd.DataFrame:
        """Tell the jobs that are due, forget those told long ago, and keep the others with a timer."""
        limit, becomes = outcomes(jobs)
        woken = (jobs["wake"] <= now).to_numpy()
        due = woken & ~jobs["told"].to_numpy(bool) & (limit > 0)
        out = pd.DataFrame({"job": jobs["job"][due], "status": jobs["status"][due], "next": becomes[due], "last": jobs["millis"][due]})
        jobs = jobs.assign(told=jobs["told"] | due, wake=jobs["wake"].where(~due, now + KEEP))[~woken | due]
        timer = int(jobs["wake"].min()) if len(jobs) else None
        if before is not None and before != timer:
            self.handle.deleteTimer(before)
        if timer is None:
            self.seen.clear()
            return out
        if before != timer:
            self.handle.registerTimer(timer)
        to = pa.BufferOutputStream()
        with pa.ipc.new_stream(to, WATCHED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(pa.Table.from_pandas(jobs, WATCHED, preserve_index=False))
        self.seen.update((timer, to.getvalue().to_pybytes()))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        before, watched = self._watched()
        new = pd.concat([pdf[["job", "status", "total", "millis"]] for pdf in rows])
        limit, _ = outcomes(new)
        # a job that needs no watching is remembered until the watermark has moved at least once
        wake = np.where(limit > 0, new["millis"] // 1000 * 1000 + limit * 1000, np.maximum(new["millis"] + KEEP, now)) + 1
        new = new.assign(told=False, wake=wake)
        jobs = pd.concat([watched, new]) if len(watched) else new
        # of equal signs the first counts
        jobs = jobs[::-1].sort_values(["job", "millis", "status"], kind="stable").drop_duplicates("job", keep="last")
        yield self._told(jobs, before, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before, watched = self._watched()
        if before is not None:
            yield self._told(watched, before, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


#: State store that timers need; set as ``spark.sql.streaming.stateStore.providerClass`` where the query starts.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stale_jobs(jobs: DataFrame, delay: str = "1 minute", buckets: int = 256) -> DataFrame:
    """Jobs that went stale by event time (K2): ``job, status, next, last`` each time one passes its limit.

    ``jobs(job, status, total, touched_at)`` are signs of life, of which the
    newest of a job counts; rows without a job or a moment are none. Jobs are
    dealt to ``buckets``, and a batch reads and writes the buckets it touches
    whole: some thousand jobs that are watched at a time make a good bucket.
    The number cannot change over a checkpoint. Needs the state store :data:`STORE`.
    """
    bucket = F.pmod(F.xxhash64("job"), F.lit(buckets)).cast("int").alias("bucket")
    timed = jobs.withWatermark("touched_at", delay).where("job is not null and touched_at is not null")
    timed = timed.select(bucket, F.col("job").cast("long").alias("job"), F.coalesce("status", F.lit("")).alias("status"), F.coalesce("total", F.lit(0)).cast("long").alias("total"), "touched_at", F.unix_millis("touched_at").alias("millis"))
    return timed.groupBy("bucket").transformWithStateInPandas(StaleJobs(), "job long, status string, next string, last long", "Append", "EventTime")
