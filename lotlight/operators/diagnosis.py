"""Why a search misses the suppliers that it should have found.

A query fails in retrieval where none of its winners is in the pool, and in
ranking where its best winner stands below ``fail_rank``.  The winner is
compared with every supplier above it by what each component contributes to
the score; the component with the largest mean deficit is the dominant cause.

A pool is bounded by the limits of retrieval, and the winner's row meets it by
a join on the query, so nothing is sorted or gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import COMPONENTS, Config, weights_in_force

#: Facts of a supplier that show the shape of its evidence.
SHAPE = ("relevant_lots", "awards", "em_participations", "age")


def _nano(c: Column) -> Column:
    """Billionths, so that sums don't depend on their order."""
    return F.round(c * 1e9).cast("long")


def _mean(c: Column) -> Column:
    return F.sum(_nano(c)).cast("double") / F.count("*") / 1e9


def contributions(config: Config = Config()) -> dict[str, Column]:
    """What each component adds to a ranked supplier's score."""
    weights = weights_in_force(config)
    whole = sum(weights.values(), F.lit(0.0))
    return {c: weights[c] * F.col(c) / F.when(whole > 0, whole).otherwise(1.0) for c in COMPONENTS}


def diagnose(pool: DataFrame, winners: DataFrame, config: Config = Config(), fail_rank: int = 10) -> DataFrame:
    """One row per query with winners.

    pool: every ranked supplier, as ``rank_suppliers`` gives them with their
    ``rank``; winners: query, supplier_id (repeats count once, nulls are none).
    ``outcome`` is RETRIEVAL_FAILURE, RANKING_FAILURE or FOUND; ``cause`` the
    dominant component of a ranking failure (ties: the last name), else null.
    ``deficits`` and ``higher`` hold for each component the mean lead of those
    above and the share of them with a higher value; ``shape`` the winner's
    facts beside the means of the first ``fail_rank`` suppliers.  Values are
    compared in billionths.  The pool is read twice: pass a written one.
    """
    asked = winners.select("query", "supplier_id").dropna().distinct()
    parts = F.struct(*[v.alias(c) for c, v in contributions(config).items()])
    rows = pool.select("query", "supplier_id", "rank", "n_items", "redundant", "same_customer", *SHAPE, F.struct(*COMPONENTS).alias("value"), parts.alias("part"))
    best = rows.join(asked, ["query", "supplier_id"], "left_semi").groupBy("query").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "query"]), "rank").alias("w"))
    # the winner beside all that stands above it, and beside the first of the ranking
    met = rows.join(best.filter(F.col("w.rank") > fail_rank), "query")
    above, first = F.col("rank") < F.col("w.rank"), F.col("rank") <= fail_rank
    lead = {c: F.greatest(F.col(f"part.{c}") - F.col(f"w.part.{c}"), F.lit(0.0)) for c in COMPONENTS}
    over = {c: (_nano(F.col(f"value.{c}")) > _nano(F.col(f"w.value.{c}"))).cast("double") for c in COMPONENTS}
    seen = met.filter(above).groupBy("query").agg(
        F.struct(*[F.round(_mean(v), 6).alias(c) for c, v in lead.items()]).alias("deficits"), F.struct(*[F.round(_mean(v), 6).alias(c) for c, v in over.items()]).alias("higher"),
        F.struct(*[F.round(F.sum(F.when(first, F.col(k))).cast("double") / F.count_if(first), 6).alias(k) for k in SHAPE]).alias("top"),
    )
    cause = F.array_max(F.array(*[F.struct(F.col(f"deficits.{c}").alias("d"), F.lit(c).alias("c")) for c in COMPONENTS]))["c"]
    outcome = F.when(F.col("w").isNull(), "RETRIEVAL_FAILURE").when(F.col("w.rank") > fail_rank, "RANKING_FAILURE").otherwise("FOUND")
    out = asked.select("query").distinct().join(best, "query", "left").join(seen, "query", "left")
    shape = F.struct(*[F.struct(F.col(f"w.{k}").cast("double").alias("winner"), F.col(f"top.{k}").alias("top")).alias(k) for k in SHAPE])
    return out.select(
        "query", outcome.alias("outcome"), F.col("w.supplier_id").alias("winner"), F.col("w.rank").alias("rank"), F.when(F.col("deficits").isNotNull(), cause).alias("cause"), "deficits", "higher", F.when(F.col("deficits").isNotNull(), shape).alias("shape"),
        F.col("w.redundant").alias("redundant"), (F.col("w.n_items") > 1).alias("several_items"), (F.col("w.same_customer") > 0).alias("known_customer"), (F.col("w.relevant_lots") == 1).alias("single_lot"),
    )


def causes(diagnosed: DataFrame) -> DataFrame:
    """For each component: how many ranking failures it dominates, its mean
    deficit and the mean share of suppliers above with a higher value."""
    failed = diagnosed.filter("outcome = 'RANKING_FAILURE'")
    told = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(f"deficits.{c}").alias("deficit"), F.col(f"higher.{c}").alias("share"), (F.col("cause") == c).alias("main")) for c in COMPONENTS]))
    return failed.select(told.alias("t")).groupBy("t.component").agg(F.count_if("t.main").alias("dominant"), F.round(_mean(F.col("t.deficit")), 4).alias("deficit"), F.round(_mean(F.col("t.share")), 3).alias("higher"))


def flags(diagnosed: DataFrame) -> DataFrame:
    """How often each outcome meets each property of query and winner."""
    names = ("redundant", "several_items", "known_customer", "single_lot")
    return diagnosed.groupBy("outcome").agg(F.count("*").alias("queries"), *[F.count_if(c).alias(c) for c in names])


def shapes(diagnosed: DataFrame) -> DataFrame:
    """Medians over ranking failures: the winner's facts and those of the first suppliers."""
    failed = diagnosed.filter("outcome = 'RANKING_FAILURE'")
    told = F.explode(F.array(*[F.struct(F.lit(k).alias("fact"), F.col(f"shape.{k}.winner").alias("winner"), F.col(f"shape.{k}.top").alias("top")) for k in SHAPE]))
    return failed.select(told.alias("t")).groupBy("t.fact").agg(F.round(F.median("t.winner"), 3).alias("winner"), F.round(F.median("t.top"), 3).alias("top"))
