"""Failure diagnosis against a plain count over every query's whole ranking."""

import random
from collections import Counter

from pyspark.sql import functions as F

from lotlight.operators import diagnosis
from lotlight.operators.search import COMPONENTS, Config

CONFIG = Config(evidence_quality=0.05, item_coverage=0.10, redundant_factor=0.5)


def weights(row):
    w = {c: getattr(CONFIG, c) for c in COMPONENTS}
    w["product_text"] *= CONFIG.redundant_factor if row["redundant"] else 1
    w["okpd2"] *= row["has_code"]
    w["same_customer"] *= row["has_customer"]
    w["item_coverage"] *= row["n_items"] >= 2
    return w


def pools(rng):
    rows = []
    for q in range(12):
        facts = {"query": q, "n_items": rng.randrange(1, 4), "has_code": rng.random() < 0.7, "has_customer": rng.random() < 0.7, "redundant": rng.random() < 0.3}
        held = []
        for s in range(rng.choice([3, 15, 40])):
            row = facts | {"supplier_id": s, "relevant_lots": rng.randrange(1, 9), "awards": rng.randrange(5), "em_participations": rng.randrange(5), "age": rng.randrange(900)}
            row |= {c: round(rng.random(), 2) for c in COMPONENTS} | {"same_customer": float(rng.random() < 0.2)}
            w = weights(row)
            row["part"] = {c: w[c] * row[c] / sum(w.values()) for c in COMPONENTS}
            held.append(row)
        held.sort(key=lambda r: (-sum(r["part"].values()), r["supplier_id"]))
        rows += [r | {"rank": i + 1} for i, r in enumerate(held)]
    return rows


def test_diagnosis_equals_a_plain_count(spark):
    rng = random.Random(5)
    rows = pools(rng)
    winners = [(q, s) for q in range(14) for s in rng.sample(range(50), 2)] + [(0, 0), (0, 0), (None, 1), (1, None)]
    told = set(winners)
    schema = "query int, supplier_id int, rank int, n_items int, has_code boolean, has_customer boolean, redundant boolean, relevant_lots int, awards int, em_participations int, age int, " + ", ".join(f"{c} double" for c in COMPONENTS)
    names = [x.split()[0] for x in schema.split(", ")]
    pool = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema).withColumn("extra", F.lit(1))
    out = diagnosis.diagnose(pool, spark.createDataFrame(winners, "query int, supplier_id int"), CONFIG)
    got = {r["query"]: r for r in out.collect()}
    want, main, kinds = {}, Counter(), Counter()
    for q in {q for q, s in told if q is not None and s is not None}:
        ranking = [r for r in rows if r["query"] == q]
        mine = [r for r in ranking if (q, r["supplier_id"]) in told]
        if not mine:
            want[q] = ("RETRIEVAL_FAILURE", None, None)
        elif mine[0]["rank"] <= 10:
            want[q] = ("FOUND", mine[0]["rank"], None)
        else:
            above = ranking[: mine[0]["rank"] - 1]
            lead = {c: sum(max(0.0, a["part"][c] - mine[0]["part"][c]) for a in above) / len(above) for c in COMPONENTS}
            want[q] = ("RANKING_FAILURE", mine[0]["rank"], max(COMPONENTS, key=lambda c: (round(lead[c], 6), c)))
            main[want[q][2]] += 1
            assert all(abs(got[q]["deficits"][c] - lead[c]) < 2e-6 for c in COMPONENTS)
            assert all(abs(got[q]["higher"][c] - sum(a[c] > mine[0][c] for a in above) / len(above)) < 2e-6 for c in COMPONENTS)
            assert abs(got[q]["shape"]["awards"]["top"] - sum(r["awards"] for r in ranking[:10]) / 10) < 2e-6 and got[q]["shape"]["age"]["winner"] == mine[0]["age"]
        kinds[want[q][0]] += 1
    assert len(kinds) == 3 and {q: (r["outcome"], r["rank"], r["cause"]) for q, r in got.items()} == want
    assert {r["component"]: r["dominant"] for r in diagnosis.causes(out).collect()} == {c: main[c] for c in COMPONENTS}
    assert {r["outcome"]: r["queries"] for r in diagnosis.flags(out).collect()} == kinds
    assert {r["fact"] for r in diagnosis.shapes(out).collect()} == set(diagnosis.SHAPE)
    assert diagnosis.diagnose(pool.limit(0), spark.createDataFrame(winners, "query int, supplier_id int"), CONFIG).filter("outcome <> 'RETRIEVAL_FAILURE'").count() == 0
