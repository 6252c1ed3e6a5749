"""Operators of loading: line order, merging, quarantine, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The contract's order of quality flags.
FLAG_ORDER = [
    "MISSING_INN", "INVALID_INN_FORMAT", "INVALID_INN_CHECKSUM", "MISSING_KPP", "INVALID_KPP_FORMAT", "MISSING_START_PRICE",
    "ZERO_START_PRICE", "MISSING_SUBJECT", "MISSING_PRODUCT_NAME", "MISSING_OKPD2", "INVALID_OKPD2", "DUPLICATE_SUPPLIER_RELATION",
]


def sort_flags(flags: Column) -> Column:
    """Distinct flags in contract order."""
    return F.filter(F.array(*[F.lit(f) for f in FLAG_ORDER]), lambda f: F.array_contains(flags, f))


def numbered(rows: DataFrame, key: str, order: list[str], name: str = "line_no") -> DataFrame:
    """Rows with their ordinal within a key, in source order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def merge_relations(rows: DataFrame, key: list[str]) -> DataFrame:
    """Repeated relations as one: won if any row won, the first non-empty
    ``kpp`` in row order, and all row numbers."""
    return rows.groupBy(*key).agg(
        F.bool_or("is_winner").alias("is_winner"),
        F.min_by("kpp", F.when(F.col("kpp").isNotNull() & (F.col("kpp") != ""), F.col("row_no"))).alias("kpp"),
        F.array_join(F.sort_array(F.collect_list("row_no")).cast("array<string>"), ",").alias("row_nos"),
    )


def split_known(rows: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a parent, and those for quarantine."""
    ids = known.select(key).distinct()
    return rows.join(ids, key, "left_semi"), rows.join(ids, key, "left_anti")


def append_new(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Insert-if-absent: what ``incoming`` adds to ``existing``."""
    return incoming.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def first_seen(existing: DataFrame, incoming: DataFrame, key: str, when: str) -> DataFrame:
    """Register keys; a first-seen date only ever moves earlier."""
    return existing.select(key, when).unionByName(incoming.select(key, when)).groupBy(key).agg(F.min(when).alias(when))


def line_gaps(lines: DataFrame, key: str, line: str = "line_no") -> DataFrame:
    """Keys whose line numbers don't run from 1 to their count."""
    held = lines.groupBy(key).agg(F.count("*").alias("n"), F.min(line).alias("lo"), F.max(line).alias("hi"))
    return held.filter((F.col("n") != F.col("hi")) | (F.col("lo") != 1))


def fingerprint(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """An order-free fingerprint of each group: the count and the sum of row
    hashes, which merges, so groups of any size are never sorted or gathered."""
    part = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns])), 1, 8), 16, 10).cast("long")
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(part).alias("fingerprint"))


def checks(expected: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """One row per named check of an expected and an actual one-number frame."""
    out = None
    for name, want, got in expected:
        row = want.toDF("expected").withColumn("_k", F.lit(1)).join(got.toDF("actual").withColumn("_k", F.lit(1)), "_k").select(F.lit(name).alias("check_name"), "expected", "actual", (F.col("expected") == F.col("actual")).alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out
