"""Codes held against the texts of their items, case by case."""

from pyspark.sql import functions as F

from lotlight.operators import validation

CASES = [
    # item, code, tokens, (state, ranking code, suggestions), expected code, status, shared
    (1, "10.51.11", ["milk", "fat"], None, "10.51.11", "SUPPLIED_ALIGNED", ["fat", "milk"]),
    (2, "10.51.11", ["steel"], ("AMBIGUOUS", None, ["25.11.10", "10.51.40"]), "10.51.11", "SUPPLIED_ALIGNED", []),
    (3, "10.51.11", ["steel"], ("RESOLVED", "25.11.10", ["25.11.10"]), "25.11.10", "RESOLVED_FROM_TEXT", []),
    (4, "10.51.11", ["steel"], ("RESOLVED", "10.20.11", ["10.20.11"]), "10.51.11", "SUPPLIED_UNVERIFIED", []),
    (5, "10.51.11", [], None, "10.51.11", "SUPPLIED_UNVERIFIED", []),
    (6, "10.5x", ["milk"], ("RESOLVED", "10.51.11", ["10.51.11"]), "10.51.11", "RESOLVED_FROM_TEXT", []),
    (7, "10.51.99", ["milk"], ("AMBIGUOUS", None, ["10.51.11"]), None, "UNRESOLVED", []),
    (8, None, None, ("RESOLVED", "25.11.10", None), "25.11.10", "RESOLVED_FROM_TEXT", []),
    (9, None, ["milk"], None, None, "UNRESOLVED", []),
    (10, "10.52", ["milk"], None, None, "UNRESOLVED", []),
    (11, " 10.51.11 ", ["a", "e", "d", "c", "b", None, "a"], ("RESOLVED", "25.11.10", []), "10.51.11", "SUPPLIED_ALIGNED", ["a", "b", "c", "d"]),
    (12, "10", ["steel"], ("AMBIGUOUS", None, ["10.20.11"]), "10", "SUPPLIED_ALIGNED", []),
]


def test_validation(spark):
    items = spark.createDataFrame([c[:3] for c in CASES], "item int, code string, tokens array<string>").withColumn("state", F.lit("clash"))
    official = spark.createDataFrame([("10.51.11", "Milk"), ("10.51.11", "Milk"), ("25.11.10", "Steel"), ("10.52", None), ("10.20.11", "Fish"), ("10", "Food")], "code string, name string")
    known = spark.createDataFrame([("10.51.11", t) for t in ["milk", "fat", "milk", "a", "b", "c", "d", "e", None]] + [("25.11.10", "steel"), (None, "milk")], "code string, token string")
    resolved = spark.createDataFrame([(c[0], *c[3]) for c in CASES if c[3]], "item int, state string, ranking_code string, suggestions array<string>")
    got = {r["item"]: (r["code"], r["status"], r["shared"]) for r in validation.validated(items, official, known, resolved).collect()}
    assert got == {c[0]: c[4:] for c in CASES}
    assert {c[5] for c in CASES} == set(validation.STATUSES)
    assert validation.validated(items.limit(0), official, known, resolved).count() == 0
