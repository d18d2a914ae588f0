"""Helpers shared by the training-data operators.

Everything that runs in a task works on Arrow batches; the driver only ever
sees aggregates of a fixed size.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session on one machine sets none (tests), a new local folder is
    made and used as checkpoint folder; on a cluster that raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    made = spark.conf.get("ledgerloom.shared.dir", None)
    if not made:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("ledgerloom.shared.dir", made)
        spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def byte_values(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x if x is not None else b"" for x in column.cast(pa.large_binary()).to_pylist()]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for internal columns that no column of ``df`` has, upper or lower case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder, read again."""
    folder = f"{shared_dir(df.sparkSession).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def join_counted(rows: DataFrame, table: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """Inner equi-join of ``rows`` with ``table``, whose column ``rows_of_key`` counts the rows of each key among ``total``.

    Keys with more than a five-hundredth of all rows, of which there are fewer
    than 500, are broadcast, so that no task gets all rows of a hot key; the
    others are joined by shuffle.
    """
    limit = max(100, total // 500)
    keys = [key] if isinstance(key, str) else key
    hot, usual = table.where(F.col("rows_of_key") > limit), table.where(F.col("rows_of_key") <= limit)
    cold = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(cold.join(usual, keys)).drop("rows_of_key")


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Forest:
    """Union-find over integer ids; the smallest id is the root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a < b:
            self.parent[b] = a
        elif b < a:
            self.parent[a] = b

    def stars(self) -> list[tuple[int, int]]:
        return [(x, self.find(x)) for x in list(self.parent) if self.find(x) != x]


def _contract(batches):
    """Replace the edges of a partition by a spanning forest of stars, a million edges at a time."""
    forest, seen = Forest(), 0

    def out():
        stars = forest.stars()
        return pa.RecordBatch.from_pydict({"u": pa.array([a for a, _ in stars], pa.int64()), "v": pa.array([b for _, b in stars], pa.int64())})

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.union(a, b)
        seen += batch.num_rows
        if seen > 1_000_000:
            yield out()
            forest, seen = Forest(), 0
    yield out()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(id, root)``, root the smallest id reachable.

    Ids without an edge are absent; an empty input gives an empty result; nulls
    and loops are ignored, repeated edges count once. Each partition first
    contracts its edges to a forest; then large-star and small-star steps
    alternate until the stars no longer change. Every step is an aggregation
    with map-side combine and an equi-join in which the few hot centres are
    broadcast; each round is checkpointed, so a lost executor costs one round.
    """
    spark = edges.sparkSession
    cur = (
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
        .mapInArrow(_contract, "u long, v long")
        .distinct()
    )
    cur, sign = cut(cur), None
    while True:
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not now[0] or now == sign:
            return cur.select(F.col("u").alias("id"), F.col("v").alias("root"))
        sign = now
        edges = int(now[0])
        low = cur.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(cur.select(F.col("v").alias("x"), F.col("u").alias("y"))).groupBy("x").agg(F.min("y").alias("y"), F.count("*").alias("rows_of_key")).select(F.col("x").alias("v"), F.least("x", "y").alias("m"), "rows_of_key")
        large = cut(join_counted(cur, low, "v", 2 * edges).select("u", F.col("m").alias("v")).where("u != v").distinct())
        first = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows_of_key"))
        pairs = join_counted(large, first, "u", edges)
        cur = pairs.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        cur = cut(cur)
