"""How concentrated the winners of a category are.

An award is one distinct lot and winning supplier.  Shares and the
Herfindahl-Hirschman index come from counts of awards per supplier.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.canonical import History


@dataclass(frozen=True)
class Thresholds:
    """Least support, and lower bounds of the tiers for either indicator."""

    min_lots: int = 20
    min_awards: int = 20
    moderate: tuple[float, float] = (0.25, 0.125)
    high: tuple[float, float] = (0.50, 0.32)
    very_high: tuple[float, float] = (0.80, 0.60)


def tier(t: Thresholds, lots: str = "lots", awards: str = "awards", top1: str = "top1_share", hhi: str = "hhi") -> Column:
    """The higher tier that either indicator reaches, if support allows one."""

    def reaches(bound: tuple[float, float]) -> Column:
        return (F.col(top1) >= bound[0]) | (F.col(hhi) >= bound[1])

    too_few = (F.col(lots) < t.min_lots) | (F.col(awards) < t.min_awards) | F.col(top1).isNull() | F.col(hhi).isNull()
    return F.when(too_few, "INSUFFICIENT_DATA").when(reaches(t.very_high), "VERY_HIGH").when(reaches(t.high), "HIGH").when(reaches(t.moderate), "MODERATE").otherwise("LOW")


def supplier_awards(history: History, scope: str) -> DataFrame:
    """code, supplier_id, awards and observed relations of every category."""
    return (
        history.categories(scope)
        .join(history.observed().select("lot_id", "supplier_id", "is_winner"), "lot_id")
        .groupBy("code", "supplier_id")
        .agg(F.count_if("is_winner").alias("awards"), F.count("*").alias("observed"))
    )


def concentration(history: History, scope: str, t: Thresholds = Thresholds()) -> DataFrame:
    """Support, shares, index and tier of every category at once."""
    order = Window.partitionBy("code").orderBy(F.desc("awards"), "supplier_id")
    ranked = supplier_awards(history, scope).withColumn("place", F.row_number().over(order))
    shares = ranked.groupBy("code").agg(
        F.sum("awards").alias("awards"),
        F.count_if(F.col("awards") > 0).alias("winning_suppliers"),
        F.count("*").alias("observed_suppliers"),
        F.max(F.when(F.col("place") == 1, F.col("awards"))).alias("top1"),
        F.sum(F.when(F.col("place") <= 3, F.col("awards"))).alias("top3"),
        F.sum(F.col("awards") * F.col("awards")).alias("squares"),
    )
    support = history.categories(scope).groupBy("code").agg(F.count("*").alias("lots"))
    total = F.when(F.col("awards") > 0, F.col("awards").cast("double"))
    out = support.join(shares, "code", "left").select(
        "code",
        "lots",
        F.coalesce("awards", F.lit(0)).alias("awards"),
        F.coalesce("winning_suppliers", F.lit(0)).alias("winning_suppliers"),
        F.coalesce("observed_suppliers", F.lit(0)).alias("observed_suppliers"),
        (F.col("top1") / total).alias("top1_share"),
        (F.col("top3") / total).alias("top3_share"),
        (F.col("squares") / (total * total)).alias("hhi"),
    )
    return out.withColumn("label", tier(t))


def analyze(history: History, scope: str, value: str, t: Thresholds = Thresholds(), recent_days: int = 365) -> DataFrame:
    """One row on one category: support, supplier counts, shares, tier."""
    in_scope = history.categories(scope).filter(F.col("code") == value).select("lot_id")
    known = history.lots().join(in_scope, "lot_id", "left_semi")
    support = known.agg(F.count("*").alias("lots"), F.countDistinct("customer").alias("customers"))
    recent = F.lit(history.as_of - timedelta(days=recent_days))
    per = (
        history.observed()
        .join(in_scope, "lot_id", "left_semi")
        .groupBy("supplier_id")
        .agg(
            F.count_if("is_winner").alias("awards"),
            F.count_if(F.col("is_winner") & (F.col("publish_date") >= recent)).alias("recent"),
            F.bool_or(F.col("platform") == "EM").alias("em"),
            F.bool_or((F.col("platform") == "EM") & F.col("is_winner")).alias("em_won"),
            F.bool_or((F.col("platform") == "AIS_GZ") & F.col("is_winner")).alias("ais_won"),
        )
    )
    # the three largest counts ride along as rows of their own, so that no list grows with the scope
    leading = per.orderBy(F.desc("awards")).limit(3).select(F.col("awards").alias("leading"))
    top = F.sort_array(F.collect_list("leading"), False)
    suppliers = per.unionByName(leading, allowMissingColumns=True).agg(
        F.count("awards").alias("observed_suppliers"),
        F.count_if(F.col("awards") > 0).alias("winning_suppliers"),
        F.count_if(F.col("recent") > 0).alias("recent_winners"),
        F.count_if("em").alias("em_observed"),
        F.count_if("em_won").alias("em_winning"),
        F.count_if("ais_won").alias("ais_winning"),
        F.coalesce(F.sum("awards"), F.lit(0)).alias("awards"),
        F.max("awards").alias("top1"),
        F.sum(F.col("awards") * F.col("awards")).alias("squares"),
        F.aggregate(F.slice(top, 1, 3), F.lit(0).cast("long"), lambda a, x: a + x).alias("top3"),
    )
    total = F.when(F.col("awards") > 0, F.col("awards").cast("double"))
    both = support.withColumn("_one", F.lit(1)).join(suppliers.withColumn("_one", F.lit(1)), "_one").drop("_one")
    out = both.withColumns({"top1_share": F.col("top1") / total, "top3_share": F.col("top3") / total, "hhi": F.col("squares") / (total * total)}).drop("top1", "top3", "squares")
    return out.withColumn("label", tier(t))


def expansion(concentrations: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Whether a pool should be widened, and the reasons."""
    label = F.col("label")
    signal = (
        F.when(label == "INSUFFICIENT_DATA", "INSUFFICIENT_DATA").when(label == "LOW", "NO_EXPANSION_SIGNAL").when(label == "MODERATE", "REVIEW_POOL").otherwise("EXPANSION_RECOMMENDED")
    )
    strong = label.isin("HIGH", "VERY_HIGH")
    reasons = F.array_compact(
        F.array(
            F.when(label == "INSUFFICIENT_DATA", "INSUFFICIENT_HISTORY").when(label == "LOW", "LOW_HISTORICAL_CONCENTRATION").otherwise(F.concat(label, F.lit("_CONCENTRATION"))),
            F.when(strong & (F.col("top1_share") >= t.very_high[0]), "DOMINANT_TOP_SUPPLIER"),
            F.when(strong & (F.col("winning_suppliers") <= 3), "LIMITED_WINNING_SUPPLIERS"),
        )
    )
    return concentrations.select("code", "label", signal.alias("signal"), F.concat_ws("|", reasons).alias("reasons"))


def alternatives(history: History, scope: str, limit: int = 10) -> DataFrame:
    """Everyone but the dominant supplier of a category, by awards."""
    order = Window.partitionBy("code").orderBy(F.desc("awards"), "supplier_id")
    ranked = supplier_awards(history, scope).withColumn("place", F.row_number().over(order))
    best = ranked.withColumn("dominant_awards", F.max("awards").over(Window.partitionBy("code")))
    return best.filter((F.col("place") > 1) & (F.col("place") <= limit + 1) & (F.col("dominant_awards") > 0)).select("code", "supplier_id", "awards", "observed", (F.col("place") - 1).alias("alternative"))
