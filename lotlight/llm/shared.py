"""Places and session settings that several operators use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of one Arrow batch between the JVM and a Python worker.  Long texts
#: make batches by row count unbounded, so they are bounded by bytes.
BATCH_BYTES = 4 << 20

#: Rows of one key up to which it is no hot one.
HOT = 256


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all machines see.

    Only where that setting is absent (a single machine, as in tests) is a
    temporary folder taken and set as the checkpoint folder.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        sc = spark.sparkContext
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        top = sc._jsc.sc().getCheckpointDir().get()
    return f"{top.rstrip('/')}/lotlight-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result no longer depends on earlier shuffles, survives the loss of
    executors, and non-deterministic parts are fixed once.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_join(big: DataFrame, small: DataFrame, keys: list[str], rows: int, limit: int = 20_000, how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where a few keys may hold most of ``big``.

    ``rows`` is the counted size of ``small`` (unique on ``keys``).  Up to
    ``limit`` rows it is broadcast; beyond that ``big`` is salted and
    ``small`` repeated once per salt, so that no key lands in one task.
    """
    if rows <= limit:
        return big.join(F.broadcast(small), keys, how)
    salts = 16
    # a hash, so that a task that runs again deals its rows as before
    spread = F.pmod(F.xxhash64(*[c for c in big.columns if c not in keys]), F.lit(salts)).cast("int")
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", spread).join(salted, [*keys, "_salt"], how).drop("_salt")


def hot_keys(big: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with so many rows of ``big`` (a written table) that a task of
    their own would be slow: more than ``HOT`` and than one in 20,000 of all
    rows, so never more than 20,000 keys."""
    limit = max(HOT, big.count() // 20_000)
    return cut(big.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys))


def skew_join(big: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """Equi-join with ``small``, which is unique on ``keys``, where some keys
    may hold most of ``big``.  The rows of ``small`` for hot keys (at most
    20,000) are broadcast; all others meet by a merge join."""
    hot = hot_keys(big, keys) if hot is None else hot
    if not hot.take(1):
        return big.join(small.hint("merge"), keys, how)
    marked = big.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    few = small.join(F.broadcast(hot), keys, "left_semi")
    return marked.filter("_hot").drop("_hot").join(F.broadcast(few), keys, how).unionByName(marked.filter("_hot is null").drop("_hot").join(small.hint("merge"), keys, how))


def numbered(df: DataFrame, group: str, order: list[str], weight: str | None = None) -> DataFrame:
    """Add each row's place ``_rank`` (from 0) in its group's order, the
    group's rows ``_n``, and with ``weight`` the sum ``_before`` of that
    column over the rows ahead.  ``df`` must be stable (written, or a plain
    scan), and ``order`` leave only rows open that are alike.

    Rows are range sorted by group and order and written with their place in
    the sorted table; running counts of its partitions make that a place in
    the group.  A group may hold most rows: it spans many partitions.
    """
    placed = cut(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))  # the upper bits are the partition's number
    whole = Window.partitionBy(group)
    ahead = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(weight or F.lit(0))
    runs = placed.groupBy("_part", group).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"), total.alias("_weight"))
    runs = runs.select("_part", group, (F.coalesce(F.sum("_rows").over(ahead), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("_n"), F.coalesce(F.sum("_weight").over(ahead), F.lit(0)).alias("_base"))
    if weight:
        inner = Window.partitionBy("_part", group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn("_own", F.coalesce(F.sum(weight).over(inner), F.lit(0)))
    out = placed.join(runs, ["_part", group]).withColumn("_rank", F.col("_at") + F.col("_shift"))
    if weight:
        out = out.withColumn("_before", F.col("_base") + F.col("_own")).drop("_own")
    return out.drop("_at", "_part", "_shift", "_base")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
