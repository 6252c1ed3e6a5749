"""The bootstrap as an aggregate against one that resamples on the driver, and the acceptance rules."""

import math

import numpy as np
from pyspark.sql import functions as F

from lotlight.operators import resample

COLUMNS = "challenger string, query long, stratum string, weight double, ndcg double, winner_recall double"


def test_draws_are_poisson(spark):
    got = spark.range(40000).select(resample.draws(F.col("id"), F.lit(3), 7).alias("n")).groupBy("n").count().collect()
    for r in got:
        want = 40000 * math.exp(-1) / math.factorial(r["n"])
        assert abs(r["count"] - want) < 5 * math.sqrt(want) + 1


def test_interval_agrees_with_multinomial_resampling(spark):
    rng = np.random.default_rng(5)
    v, w = rng.normal(0.03, 0.2, 400), np.round(rng.uniform(0.5, 3, 400), 4)
    rows = spark.createDataFrame([("a", i, float(x), float(y)) for i, (x, y) in enumerate(zip(v, w))], "c string, k long, v double, w double")
    got = resample.bootstrap(rows, "c", "k", "v", "w", 1000).first()
    times = rng.multinomial(400, np.full(400, 1 / 400), size=4000)
    means = (times @ (v * w)) / (times @ w)
    spread = means.std()
    assert abs(got["delta"] - (v @ w) / w.sum()) < 2e-6
    assert abs(got["low"] - np.quantile(means, 0.05)) < 0.25 * spread
    assert abs(got["high"] - np.quantile(means, 0.95)) < 0.25 * spread


def test_bootstrap_ignores_partitions_and_rows_without_value_or_weight(spark):
    rows = [("a", i, 0.1 * (i % 7), 1.0) for i in range(60)] + [("a", 100, None, 1.0), ("a", 101, 9.0, None), ("a", 102, 9.0, 0.0), ("a", 103, 9.0, -1.0)]
    df = spark.createDataFrame(rows, "c string, k long, v double, w double")
    one, many = (resample.bootstrap(df.repartition(n), "c", "k", "v", "w", 200).collect() for n in (1, 13))
    plain = resample.bootstrap(df.limit(60).filter("k < 60"), "c", "k", "v", "w", 200).collect()
    assert one == many == plain
    assert resample.bootstrap(df.limit(0), "c", "k", "v", "w", 200).count() == 0


def test_acceptance_rules(spark):
    def rows(name, gain, recall=0.0, bad=0.0, n_bad=0):
        good = [(name, i, "s", 1.0, gain + 0.001 * (i % 3), recall) for i in range(60)]
        return good + [(name, 100 + i, "t", 0.01, bad, recall) for i in range(n_bad)]

    cases = rows("good", 0.05) + rows("small", 0.005) + rows("forgets", 0.05, -0.01) + rows("stratum", 0.05, 0.0, -0.2, 12) + rows("few", 0.05, 0.0, -0.2, 9)
    noisy = [("noisy", i, "s", 1.0, (1.0 if i % 2 else -0.9), 0.0) for i in range(40)]
    got = {r["challenger"]: r for r in resample.accepted(spark.createDataFrame(cases + noisy, COLUMNS), resamples=200).collect()}
    assert {n: r["accepted"] for n, r in got.items()} == {"good": True, "small": False, "forgets": False, "stratum": False, "few": True, "noisy": False}
    assert [got[n][c] for n, c in (("small", "gain_ok"), ("forgets", "recall_ok"), ("stratum", "strata_ok"), ("noisy", "gain_ok"))] == [False] * 4
    assert got["noisy"]["gain"] >= 0.01 and got["noisy"]["low"] < 0
