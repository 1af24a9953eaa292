"""Helpers that the training-data operators share: scratch tables, size-checked broadcasts, distributed ranks, components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only when its measured size is below this many bytes; larger sides are joined by shuffle.
BROADCAST_BYTES = 128 << 20
#: Settings while a table is staged: Spark deletes the shuffle files of a query as it ends, and sends texts to Python in
#: batches of at most these bytes, so that an executor's memory does not grow with the length of texts.
_STAGING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
#: Folders of the scopes that are open, the innermost last.
_scopes: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where it is unset, a session that runs in this process alone gets a temporary folder; on a cluster that is an error, as
    its executors would write where others cannot read.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{tempfile.gettempdir()}/lodeworks-{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession):
    """A scope: tables that are staged inside are deleted at its end. What is kept goes to the scope around it.

    Each operator opens its own, so that its scratch tables live as long as the call, and no longer; what it returns
    reads tables that it has kept. Outside of any scope these stay until their reader deletes them.
    """
    folder = f"{shared_dir(spark)}/lodeworks/{uuid.uuid4().hex}"
    token = _scopes.set((*_scopes.get(), folder))
    try:
        yield
    finally:
        _scopes.reset(token)
        delete(spark, folder)


def scratch_path(spark: SparkSession, what: str, kept: bool = False) -> str:
    """A new path of the innermost scope, or of the one around it."""
    open_ = _scopes.get()[:-1] if kept else _scopes.get()
    return f"{open_[-1] if open_ else f'{shared_dir(spark)}/lodeworks/kept'}/{what}-{uuid.uuid4().hex}"


def stage(df: DataFrame, what: str = "stage", kept: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and lost executors do not lose it."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, what, kept)
    before = {k: spark.conf.get(k, None) for k in _STAGING}
    for k, v in _STAGING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def keep(df: DataFrame, what: str = "kept") -> DataFrame:
    """df staged in the scope around the innermost one: the result of an operator."""
    return stage(df, what, kept=True)


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if it is within BROADCAST_BYTES, else with one for a shuffle join.

    row_bytes is what a row takes in a join's table: 8 bytes a column of fixed width, and the measured contents of others.
    Spark's own table adds about as much again, and 64 bytes a row for its keys and pointers.
    """
    return F.broadcast(df) if rows * (2 * row_bytes + 64) <= BROADCAST_BYTES else df.hint("merge")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with column ``name``: the row's place (from 0) in the order of keys.

    A range shuffle sorts; places inside a partition are counted by Spark, and the partitions' starts come from a
    table with one row a partition, so that no task sees more than its own range.
    """
    spark = df.sparkSession
    placed = (
        df.repartitionByRange(partitions(spark), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_m", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_m", 33))
        .withColumn("_at", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_m")
    )
    placed = stage(placed, "ranked")
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # one row a partition: bounded by the number of shuffle partitions
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node. Nodes are longs.

    Alternates large-star and small-star steps: each node links its larger neighbours, then its smaller ones, to the
    smallest node known. Every step is a shuffle over edges, staged so that lineage stays short. Ends when a round
    changes nothing.
    """
    def minimum(pairs: DataFrame) -> DataFrame:
        low = stage(pairs.groupBy("u").agg(F.min("v").alias("m")), "low")
        return pairs.join(low, "u").select("u", "v", F.least("u", "m").alias("m"))

    cur = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    sign = None
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stage(minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        m = minimum(large)
        small = m.select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v")))
        cur = stage(small.where("u <> v").distinct(), "small")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31))).first()
        if tuple(now) == sign:
            break
        sign = tuple(now)
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
