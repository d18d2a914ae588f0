"""A stored ledger that a restarted stream picks up where it stopped.

Tables are cut into a fixed number of buckets by a hash of their key. An epoch
writes new files for the buckets it touches and then commits a manifest, a small
file that names the folder of every bucket and the last epoch of every query. A
manifest appears whole, by a rename that fails if its version exists; files
without one are never read. An epoch that is committed already is left alone, so
a query that dies between its write and its own checkpoint may send it again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Ledgers:
    """Tables under one folder, each bucketed by ``key``; ``tables`` gives their schemas.

    ``buckets`` is fixed at creation; an epoch rewrites only those it touches,
    so choose it such that one bucket is a fraction of what a batch brings.
    """

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, T.StructType], key: str = "dossier", buckets: int = 16) -> None:
        self.spark, self.path, self.tables, self.key, self.buckets = spark, path.rstrip("/"), tables, key, buckets
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/manifest"))

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def manifest(self) -> dict:
        """The newest committed version: folders of the buckets of every table, and the last epoch of every query."""
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/manifest"))]
        done = sorted(n for n in found if n.endswith(".json") and n[0] not in "._")
        if not done:
            return {"version": 0, "folders": {}, "epochs": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{done[-1]}", wholetext=True).first()[0])

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a table as last committed, of some buckets or of all."""
        folders = self.manifest()["folders"].get(table, {})
        paths = [f for b, f in folders.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.tables[table]).parquet(*paths) if paths else self.spark.createDataFrame([], self.tables[table])

    def committed(self, query: str, epoch: int) -> bool:
        return self.manifest()["epochs"].get(query, -1) >= epoch

    def commit(self, query: str, epoch: int, buckets: list[int], new: dict[str, DataFrame]) -> None:
        """Replace these buckets of some tables; readers see all of it or nothing."""
        last = self.manifest()
        folders = {t: dict(f) for t, f in last["folders"].items()}
        for table, df in new.items():
            place = f"{self.path}/{table}/{query}-{epoch}-{uuid.uuid4().hex}"
            columns = [f.name for f in self.tables[table]]
            df.select(*columns, self.bucket().alias("bucket_of_key")).repartition("bucket_of_key").write.partitionBy("bucket_of_key").parquet(place)
            written = {s.getPath().getName() for s in self._fs.listStatus(self._path(place))}
            of_table = folders.setdefault(table, {})
            for b in buckets:
                of_table.pop(str(b), None)
                if f"bucket_of_key={b}" in written:
                    of_table[str(b)] = f"{place}/bucket_of_key={b}"
        version = last["version"] + 1
        self._publish(version, {"version": version, "folders": folders, "epochs": last["epochs"] | {query: epoch}})

    def _publish(self, version: int, manifest: dict) -> None:
        name = f"{self.path}/manifest/{version:012}.json"
        draft = self._path(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(self._path(name)) or not self._fs.rename(draft, self._path(name)):
            raise RuntimeError(f"version {version} was committed by another writer")


def touched(ledgers: Ledgers, batch: DataFrame) -> list[int]:
    """Buckets that a batch brings rows for: at most as many as there are."""
    return sorted(r[0] for r in batch.select(ledgers.bucket().alias("b")).distinct().collect())


def merging(ledgers: Ledgers, query: str, merge: Callable[[DataFrame, DataFrame], DataFrame], table: str = "lines", count: Callable[[DataFrame], DataFrame] | None = None, counts: str = "counts") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer that merges each batch into the ledger (K1), and keeps counts of its keys (K4).

    ``count(lines)`` gives one row for each key. Only the keys that the batch
    touches are counted again, and ledger and counts are committed together. A
    query that starts over with a new checkpoint needs a new name.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        if ledgers.committed(query, epoch):
            return
        batch = batch.persist()
        try:
            at = touched(ledgers, batch)
            if not at:
                return
            merged = merge(ledgers.read(table, at), batch).persist()
            new = {table: merged}
            if count is not None:
                keys = batch.select(ledgers.key).distinct()
                stays = ledgers.read(counts, at).join(keys, ledgers.key, "left_anti")
                new[counts] = stays.unionByName(count(merged.join(keys, ledgers.key, "left_semi")))
            ledgers.commit(query, epoch, at, new)
            merged.unpersist()
        finally:
            batch.unpersist()

    return run
