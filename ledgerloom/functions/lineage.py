"""Shared folder, and results kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session on one machine sets none (tests), a new local folder is
    made; on a cluster that raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("ledgerloom.shared.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("ledgerloom.shared.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Spark's setting by which the shuffle files of a query are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once: for results that several later steps read, and where plans would grow too large.

    The rows go into a compressed columnar table in the shared folder, a small
    part of what a checkpoint of serialised rows takes. What was shuffled to make
    them leaves the local disks at once, not when the driver collects garbage, so
    the steps of a query need the disk of the largest, not of all.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def cut_in_order(df: DataFrame) -> DataFrame:
    """As :func:`cut`, where rows must keep their partitions and the order within them, which files do not promise: a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
