"""Paired bootstrap as an aggregate, and acceptance of challengers.

Each row takes part in each resample as often as a Poisson draw of mean 1
says, which comes from a hash of the row's key and the resample's number.  No
row has to know the others, so all resamples are one grouped sum that Spark
adds up before the shuffle: what travels is one row a resample, challenger
and partition, whatever the number of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Chances of at most 0, 1, ... draws, in units of 2^-32; beyond 12 draws nothing is left of 2^32.
CUTS = [round(2**32 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(12)]

#: Differences and weights are whole numbers of these parts, so sums don't depend on their order.
PARTS, WEIGHT_PARTS = 10**6, 10**4


#: Draws that one task makes.
DRAWS = 20_000_000


@dataclass(frozen=True)
class Acceptance:
    """Rules declared before a challenger is measured; fixed values."""

    min_gain: float = 0.01
    min_recall: float = -0.005
    stratum_queries: int = 10
    stratum_loss: float = 0.05


def draws(key: Column, resample: Column, seed: int) -> Column:
    """How often a row takes part in a resample."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), resample.cast("string")))
    at = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return sum(((at >= c).cast("int") for c in CUTS), F.lit(0))


def bootstrap(rows: DataFrame, by: str, key: str, value: str, weight: str, resamples: int = 2000, seed: int = 7) -> DataFrame:
    """For each ``by``: the weighted mean of ``value`` (``delta``) and the 90 %
    interval of resampled means (``low``, ``high``).

    Rows without a value or with a weight that is null or not above zero take
    no part; a resample that draws no row has no mean and is left out of the
    interval.  Means are cut to six decimals.
    """
    kept = rows.filter(F.col(value).isNotNull() & (F.col(weight) > 0))
    kept = kept.select(by, key, F.round(F.col(weight) * WEIGHT_PARTS).cast("long").alias("_w"), F.round(F.col(value) * PARTS).cast("long").alias("_v"))
    # a key's rows share its draws, which are the work: it deals the rows, for they are few bytes; resample 0 is the rows themselves
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() * resamples / DRAWS))
    shared = kept.repartition(tasks, key).groupBy(key).agg(F.collect_list(F.struct(by, "_w", "_v")).alias("_rows"))
    each = shared.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(resamples))))
    each = each.select("_b", "_rows", draws(F.col(key), F.col("_b"), seed).alias("_n")).select("_b", "_n", F.inline("_rows"))
    each = each.withColumn("_w", F.col("_w") * F.when(F.col("_b") == 0, 1).otherwise(F.col("_n")))
    mean = F.expr("floor(try_divide(sum(_w * _v), sum(_w)))").cast("long")
    means = each.groupBy(by, "_b").agg(mean.alias("_m")).filter("_m is not null")
    # a challenger has as many means as there are resamples
    held = means.groupBy(by).agg(F.max(F.when(F.col("_b") == 0, F.col("_m"))).alias("delta"), F.sort_array(F.collect_list(F.when(F.col("_b") > 0, F.col("_m")))).alias("_s"))
    place = lambda q: F.get("_s", F.floor(q * F.size("_s")).cast("int"))
    return held.select(by, *[(c / PARTS).alias(n) for n, c in (("delta", F.col("delta")), ("low", place(0.05)), ("high", place(0.95)))])


def accepted(differences: DataFrame, rules: Acceptance = Acceptance(), resamples: int = 2000, seed: int = 7) -> DataFrame:
    """Whether each challenger passes: differences (challenger, query,
    stratum, weight, ndcg, winner_recall), each challenger minus base.

    The gain must be large enough with an interval above zero, recall must not
    fall, and no stratum with enough queries may lose much; a challenger that
    has no such stratum loses in none.
    """
    differences = written(differences.select("challenger", "query", "stratum", "weight", "ndcg", "winner_recall"))
    gain = bootstrap(differences, "challenger", "query", "ndcg", "weight", resamples, seed).select("challenger", F.col("delta").alias("gain"), "low", "high")
    # the guard of recall takes the mean alone, no resamples
    recall = bootstrap(differences, "challenger", "query", "winner_recall", "weight", 1, seed).select("challenger", F.col("delta").alias("recall"))
    strata = differences.groupBy("challenger", "stratum").agg(F.count("*").alias("n"), (F.floor(F.sum(F.round(F.col("ndcg") * PARTS).cast("long")) / F.count("*")) / PARTS).alias("_d"))
    worst = strata.groupBy("challenger").agg(F.min(F.when(F.col("n") >= rules.stratum_queries, F.col("_d"))).alias("worst_stratum"))
    out = gain.join(recall, "challenger").join(worst, "challenger")
    checks = {
        "gain_ok": (F.col("gain") >= rules.min_gain) & (F.col("low") > 0),
        "recall_ok": F.col("recall") >= rules.min_recall,
        "strata_ok": F.coalesce(F.col("worst_stratum") >= -rules.stratum_loss, F.lit(True)),
    }
    return out.select("*", *[c.alias(n) for n, c in checks.items()]).withColumn("accepted", F.expr(" and ".join(checks)))
