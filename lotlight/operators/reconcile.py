"""Known, new and invalid supplier candidates against the history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.canonical import History


def candidates(history: History, given: DataFrame, scope: str, target: str) -> DataFrame:
    """Status of every candidate (supplier_id, valid): INVALID_INN,
    CATEGORY_HISTORICAL, HISTORICAL_OTHER_CATEGORY or EXTERNAL_NEW."""
    seen = history.observed().join(given.filter("valid").select("supplier_id").distinct(), "supplier_id", "left_semi")
    in_target = history.categories(scope).filter(F.col("code") == target).select("lot_id", F.lit(True).alias("hit"))
    facts = (
        seen.join(in_target, "lot_id", "left")
        .groupBy("supplier_id")
        .agg(
            F.min("publish_date").alias("first_seen"),
            F.max("publish_date").alias("last_seen"),
            F.count("*").alias("lots"),
            F.count_if("is_winner").alias("wins"),
            F.count_if("hit").alias("target_lots"),
            F.count_if(F.col("hit") & F.col("is_winner")).alias("target_wins"),
        )
    )
    status = F.when(~F.col("valid"), "INVALID_INN").when(F.col("target_lots") > 0, "CATEGORY_HISTORICAL").when(F.col("lots") > 0, "HISTORICAL_OTHER_CATEGORY").otherwise("EXTERNAL_NEW")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("lots", "wins", "target_lots", "target_wins")]
    return given.join(facts, "supplier_id", "left").select("supplier_id", status.alias("status"), "first_seen", "last_seen", *zero)
