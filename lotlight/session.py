"""Sessions and table access."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; on a cluster the master and sizes
    come from the submit command, so only semantics are set here."""
    builder = SparkSession.builder.appName("lotlight").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    return builder.config(map=conf).getOrCreate() if conf else builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of the largest table that one task takes after ``spread``.  What a task
#: holds beside them (pairs of a lot's suppliers and codes, hash tables, sorts)
#: is some kilobytes a row in the longest stages.
ROWS = 250_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over tasks of about ``ROWS`` rows, ``rows`` in
    all: adaptive execution joins small partitions by their compressed bytes,
    which for keys and flags hold so many rows that a task's memory grows with
    the table; a number that is asked for stays."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / ROWS)), *keys)


def folder(spark: SparkSession) -> str:
    """A new folder that all machines see, below ``spark.checkpoint.dir``;
    only where that is unset and the master is local, a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        top = tempfile.mkdtemp(prefix="spark-")
    return f"{top.rstrip('/')}/core-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to a new shared folder and read back: later parts of a
    query read it as often as they like, and lost executors cost no rerun."""
    path = folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
