"""Streams over the append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import folder

#: Fixed value: the log's schema; streams don't infer one.
LOG = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def windowed(log: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by tumbling window and kind; rows later than the watermark go."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


def source(spark: SparkSession, path: str) -> DataFrame:
    """The log as a stream over a file or a folder."""
    reader = spark.readStream.schema(LOG)
    if any(f.rstrip("/").endswith(path.rstrip("/").rpartition("/")[2]) for f in spark.read.schema(LOG).parquet(path).inputFiles()):
        # one file: streams read folders, so its folder is read with the file's name as filter
        folder_of, _, name = path.rpartition("/")
        reader, path = reader.option("pathGlobFilter", name), folder_of
    return reader.parquet(path)


def daily_counts(spark: SparkSession, path: str) -> DataFrame:
    """Run the windowed count over all files there are, then read its output."""
    out_dir = folder(spark)
    log = source(spark, path)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/out/batch={number}")

    stream = windowed(log).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out_dir}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    last = stream.lastProgress.batchId if stream.lastProgress else 0
    out = spark.read.parquet(f"{out_dir}/out/batch={last}")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "users")
