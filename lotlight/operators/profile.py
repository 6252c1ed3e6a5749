"""Profiles: quantiles by four conventions, histograms, cross-tabs, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quantiles(rows: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """One quantile of each group by four conventions: floor rank, linear
    interpolation, index of q (n - 1) rounded down, and rounded half to even.

    Values are first counted, so a group's rows meet as distinct values with
    running counts."""
    held = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(key).orderBy(value)
    running = held.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy(key)))
    last = F.col("n") - 1
    place = {"floor_rank": F.least(last, F.floor(F.col("n") * q)), "low_index": F.floor(last * q), "round_index": F.bround(last * q, 0).cast("long"), "high_index": F.ceil(last * q)}
    picked = running.groupBy(key).agg(F.first("n").alias("n"), *[F.min(F.when(F.col("upto") > c, F.col(value))).alias(k) for k, c in place.items()])
    part = (F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)
    return picked.withColumn("linear", F.col("low_index") + (F.col("high_index") - F.col("low_index")) * part).drop("high_index")


def top_counts(rows: DataFrame, value: str, limit: int) -> DataFrame:
    """The most frequent values, ties by value (a report)."""
    return rows.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(limit)


def capped_histogram(rows: DataFrame, value: str, cap: int) -> DataFrame:
    """Counts by value, all from ``cap`` on in one bucket."""
    return rows.groupBy(F.least(F.col(value), F.lit(cap)).alias("bucket")).agg(F.count("*").alias("n"))


def competition_ranks(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rank by strictly greater values and the number of ties."""
    counted = rows.groupBy(key, value).agg(F.count("*").alias("ties"))
    w = Window.partitionBy(key).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("rank", F.coalesce(F.sum("ties").over(w), F.lit(0)) + 1)
    return rows.join(ranked, [key, value])


def seen_before(rows: DataFrame, keys: list[str], when: str) -> DataFrame:
    """Whether the same keys occur at an earlier date."""
    first = rows.groupBy(*keys).agg(F.min(when).alias("_first"))
    return rows.join(first, keys).withColumn("seen_before", F.col("_first") < F.col(when)).drop("_first")


def weighted_mean(rows: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    return rows.groupBy(key).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, by an aggregate that merges before the shuffle."""
    others = [c for c in rows.columns if c != key]
    best = F.max(F.struct(*order, *[c for c in others if c not in order]))
    return rows.groupBy(key).agg(best.alias("_b")).select(key, *[F.col(f"_b.{c}").alias(c) for c in others])
