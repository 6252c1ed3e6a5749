from datetime import date

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lotlight.operators import asof, enrich, evaluation, ingest, pool_health, profile, search, similar, vectors
from lotlight.operators.vectors import nearest
from lotlight.sources import files

ROOT = "/root/testdata/sf0.001"


class World:
    """A small history with the traps of the domain."""

    as_of = date(2024, 6, 1)

    def __init__(self, spark):
        self.spark = spark
        lots = [(1, date(2024, 1, 1), 7, "EM"), (2, date(2024, 2, 1), None, "EM"), (3, date(2024, 3, 1), 7, "AIS_GZ"), (4, date(2024, 6, 1), 8, "EM"), (5, date(2025, 1, 1), 8, "EM")]
        rel = [(1, 10, True), (1, 11, False), (2, 10, True), (2, 12, False), (3, 12, True), (3, 13, False), (4, 14, True), (5, 14, True)]
        self._lots = spark.createDataFrame(lots, "lot_id long, publish_date date, customer long, platform string")
        self._rel = spark.createDataFrame(rel, "lot_id long, supplier_id long, is_winner boolean").join(self._lots.drop("customer"), "lot_id")
        codes = [(1, "a")] * 50 + [(1, "b"), (2, "a"), (3, "a"), (4, "a"), (5, "a"), (2, "zero")]
        self._items = spark.createDataFrame(codes, "lot_id long, code string").join(self._lots.select("lot_id", "publish_date"), "lot_id")

    def lots(self):
        return self._lots.filter(F.col("publish_date") < F.lit(self.as_of))

    def relations(self):
        return self._rel.filter(F.col("publish_date") < F.lit(self.as_of))

    def observed(self):
        from lotlight.sources.canonical import observed

        return self.relations().filter(observed())

    def categories(self, scope):
        return self._items.filter(F.col("publish_date") < F.lit(self.as_of)).select("lot_id", "code").distinct()


def test_pool_counts_lots_not_rows_and_never_the_future(spark):
    got = {r.code: r for r in pool_health.concentration(World(spark), "code", pool_health.Thresholds(1, 1)).collect()}
    a = got["a"]
    assert (a.lots, a.awards, a.winning_suppliers, a.observed_suppliers) == (3, 3, 2, 3)
    assert a.top1_share == pytest.approx(2 / 3) and a.top3_share == 1.0 and a.hhi == pytest.approx(5 / 9) and a.label == "HIGH"
    assert got["b"].label == "VERY_HIGH"
    one = pool_health.analyze(World(spark), "code", "a", pool_health.Thresholds(1, 1)).first()
    assert (one.lots, one.customers, one.awards, one.label, one.ais_winning, one.em_observed) == (3, 1, 3, "HIGH", 1, 3)
    assert [r.supplier_id for r in pool_health.alternatives(World(spark), "code").filter("code = 'a'").orderBy("alternative").collect()] == [12, 11]


@pytest.mark.parametrize("counts,want", [([94, 4, 2], (0.94, 1.0, 0.8856)), ([1, 1, 1, 1], (0.25, 0.75, 0.25))])
def test_shares(spark, counts, want):
    class Only(World):
        def observed(self):
            rows = [(n * 1000 + i, n, True) for n, c in enumerate(counts) for i in range(c)]
            return spark.createDataFrame(rows, "lot_id long, supplier_id long, is_winner boolean")

        def categories(self, scope):
            return self.observed().select("lot_id", F.lit("x").alias("code"))

    r = pool_health.concentration(Only(spark), "code").first()
    assert (r.top1_share, r.top3_share, round(r.hhi, 10)) == pytest.approx(want)


def test_relation_merge_keeps_first_kpp_and_rows(spark):
    rows = spark.createDataFrame([(1, 5, False, "", 1), (1, 5, True, "K2", 2), (1, 5, False, "K3", 3), (1, 6, False, None, 4)], "lot_id long, supplier_id long, is_winner boolean, kpp string, row_no int")
    got = {r.supplier_id: tuple(r)[2:] for r in ingest.merge_relations(rows, ["lot_id", "supplier_id"]).collect()}
    assert got == {5: (True, "K2", "1,2,3"), 6: (False, None, "4")}


def test_quantile_conventions(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 12)], "k string, v double")
    r = profile.quantiles(rows, "k", "v", 0.5).first()
    assert (r.floor_rank, r.low_index, r.round_index, r.linear) == (6, 6, 6, 6)


def test_allocation():
    got = evaluation.allocate({"a": 100, "b": 1, "c": 25, "d": 0}, 30)
    assert sum(got.values()) == 30 and got["b"] == 1 and got["d"] == 0 and got["a"] > got["c"]
    assert evaluation.allocate({"a": 2}, 9) == {"a": 2}


def test_bootstrap_and_metrics(spark):
    mean, lo, hi = evaluation.paired_bootstrap(spark.createDataFrame([(0.1,)] * 50 + [(-0.1,)] * 10, "d double"), "d")
    assert lo < mean < hi and mean == pytest.approx(0.0667, abs=1e-3)
    ranked = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query long, supplier_id long, rank int")
    relevant = spark.createDataFrame([(1, 6, 2), (1, 9, 1)], "query long, supplier_id long, grade int")
    m = evaluation.metrics(ranked, relevant).first()
    assert (m.winner_recall, m.observed_recall, m.mrr) == (1.0, 0.5, 0.5)


def test_nearest_breaks_ties_by_id(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r.vec_id, r.place) for r in nearest(v, v.filter("vec_id = 1"), 3).orderBy("place").collect()]
    assert got == [(2, 1), (3, 2), (4, 3)]
    assert nearest(v, v.filter("false"), 3).count() == 0


def test_weak_refresh_and_reuse(spark):
    old = spark.createDataFrame([(1, "s", "p"), (2, "s", None)], "k long, site string, phone string")
    new = spark.createDataFrame([(1, None, "q"), (3, "n", None)], "k long, site string, phone string")
    got = {r.k: (r.site, r.phone, r.refresh, r.kept_fields) for r in enrich.merge_refresh(old, new, "k", ["site", "phone"]).collect()}
    assert got == {1: ("s", "q", "KEPT", "site"), 2: ("s", None, "UNTOUCHED", ""), 3: ("n", None, "REPLACED", "")}


def test_delimited_and_xml_sources(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text('﻿lot_id;supplier_inn;supplier_kpp;is_winner\n1;"77;07";;true\n2;78;K;false\n', encoding="utf-8")
    rows = files.delimited(spark, str(p), "suppliers").orderBy("row_no").collect()
    assert [(r.row_no, r.lot_id, r.supplier_inn, r.supplier_kpp, r.is_winner) for r in rows] == [(1, "1", "77;07", "", "true"), (2, "2", "78", "K", "false")]
    assert files.header_drift(spark, str(p), "suppliers") == [] and files.header_drift(spark, str(p), "items")
    assert files.checksums(spark, str(p)).first().size_bytes == p.stat().st_size
    good, bad = files.lenient(spark, str(p), 4)
    assert good.count() + bad.count() == 3 and bad.count() == 1
    xml = "<contract><id>9</id><publishDate>2024-01-02</publishDate><priceInfo><price>5.50</price></priceInfo><products><product><name>pen</name><OKPD2><code>32.99</code></OKPD2></product></products><suppliers><supplier><inn>77</inn></supplier></suppliers></contract>"
    docs = spark.createDataFrame([(xml,), ("<!DOCTYPE x><contract/>",), (None,)], "xml string")
    parsed = files.contracts(docs)
    assert parsed.count() == 1 and files.contract_items(parsed).first().code == "32.99"


def test_violations_count_nulls(spark):
    rows = spark.createDataFrame([(1,), (None,), (-1,)], "x int")
    assert {r.rule: r.violations for r in enrich.violations(rows, {"positive": "x > 0"}).collect()} == {"positive": 2}


def test_query_items_and_alignment(spark):
    rows = [(1, 1, "red", "a.b"), (1, 2, "red", "a.b"), (1, 3, "common", "a"), (1, 4, "ab123 red", None), (1, 5, None, None), (2, 1, None, "c")]
    items = spark.createDataFrame(rows, "lot_id long, line int, name string, code string")
    frequency = spark.createDataFrame([("red", 2), ("common", 9)], "token string, df long")
    got = search.query_items(items, frequency, 9, limit=2).orderBy("lot_id", "place").collect()
    assert [(r.lot_id, r.line, r.name, r.place) for r in got] == [(1, 1, "red", 1), (1, 4, "ab123 red", 2), (2, 1, "", 1)]
    hints = [(1, "a.b.1", "a.b", 0.9, 1, 5), (2, "a.c", "a.b", 0.1, 1, 5), (2, "a.c", "a.c", 0.1, 2, 5), (3, "z", "a.b", 0.9, 1, 5), (4, "a.b", "a.b", 0.9, 1, 2), (5, None, "a.b", 0.9, 1, 5)]
    named = spark.createDataFrame(hints, "query long, provided string, code string, share double, place int, support long")
    assert {r["query"]: r.alignment for r in search.alignment(named).collect()} == {1: "ALIGNED", 2: "UNCERTAIN", 3: "MISMATCH", 4: "UNCERTAIN", 5: None}


def test_registry():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and "category_concentration" in o


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_counts_before_equal_a_plain_count(spark):
    import random

    rng = random.Random(4)
    day = lambda: date(2024, 1, rng.randint(1, 20))
    events = [(rng.choice("ab"), rng.randint(1, 4), day()) for _ in range(200)] + [("a", 9, None), (None, 1, day())]
    asked = [(rng.choice("abc"), day()) for _ in range(30)]
    got = asof.counts_before(spark.createDataFrame(events, "g string, m int, publish_date date"), spark.createDataFrame(asked, "g string, as_of date"), "g", "m")
    want = {(g, d, m): n for g, d in asked for m in range(10) if (n := sum(e[0] == g and e[1] == m and e[2] is not None and e[2] < d for e in events))}
    assert {(r["g"], r["as_of"], r["m"]): r["n"] for r in got.collect()} == want


def test_sample_by_threshold_equals_a_whole_ranking(spark):
    rows = spark.range(5000).select(F.col("id").alias("lot_id"), F.when(F.col("id") % 50 == 0, "rare").otherwise("many").alias("stratum"))
    got = evaluation.stratified(rows, 120, 3).collect()
    given = evaluation.allocate({"rare": 100, "many": 4900}, 120)
    keys = {r["lot_id"]: (r["k"], r["stratum"]) for r in rows.withColumn("k", evaluation.sampling_key(3, F.col("lot_id"))).collect()}
    want = {i for s, n in given.items() for i in sorted((i for i in keys if keys[i][1] == s), key=lambda i: keys[i][0])[:n]}
    assert {r["lot_id"] for r in got} == want


def test_substrings_by_trigrams_equal_contains(spark):
    import random

    rng = random.Random(8)
    texts = ["".join(rng.choice("ab_%1 é") for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["x" * 30_000 + "a_b"]
    tokens = [t[i : i + n] for t in texts[:60] for i, n in ((0, 3), (3, 4), (7, 6))] + ["ab", "zzz", "a_b", "%1%"]
    found = search.containing(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id")
    assert {(r["token"], r["id"]) for r in found.collect()} == {(t, i) for t in set(tokens) if len(t) >= 3 for i, x in enumerate(texts) if t in x}


def test_all_tokens_are_asked_for_where_none_is_rare(spark):
    names = ["red steel bolt", "red bolt", "steel bolt red long", "blue steel", "red steel", "bolt", "q7-x100 red"]
    code = "struct<code:string,class:string,subclass:string,`group`:string,subgroup:string,kind:string>"
    items = spark.createDataFrame([(lot, i, 1, date(2024, 1, 1), n, None) for lot in range(3) for i, n in enumerate(names)], f"lot_id long, part long, line int, publish_date date, text string, code {code}")
    config = search.Config(max_df_ratio=0.2)
    catalogue = search.Catalogue.of(items)
    asked = catalogue.features(spark.createDataFrame([("red steel",), ("bolt",), ("red long",), ("x100",)], "text string"), "text", config).withColumnRenamed("text", "key")
    got = {}
    for r in search.matching_texts(asked, catalogue, config).collect():
        got.setdefault(r["key"], set()).add(r["text"])
    assert got == {"red steel": {"red steel bolt", "steel bolt red long", "red steel"}, "bolt": {"red steel bolt", "red bolt", "steel bolt red long", "bolt"}, "red long": {"steel bolt red long"}}
    technical = catalogue.features(spark.createDataFrame([("x100a",), ("-x100",)], "text string"), "text", config).withColumnRenamed("text", "key")
    assert {(r["key"], r["lot_id"]) for r in search.technical_hits(technical, catalogue, config).collect()} == {("-x100", 0), ("-x100", 1), ("-x100", 2)}


@pytest.mark.parametrize("least", [0.88, 0.8, 0.7])
def test_similar_words_equal_all_pairs(spark, least):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(int(least * 100))
    terms = ["".join(rng.choice("abcdeéж") for _ in range(rng.randint(4, 18))) for _ in range(150)] + ["abababab", "aaaaaaa", "aaaaaaaa"]

    def typo(t):
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(t) + 1)
            t = rng.choice([t[:i] + rng.choice("abcdeжz") + t[i:], t[:i] + t[i + 1 :], t[:i] + "q" + t[i + 1 :], t[1:] + t[:1]])
        return t

    words = [typo(t) for t in terms for _ in range(3)] + ["babababa", None, "", "aaaaaaaaa"]
    got = similar.similar(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in terms] * 2, "term string"), least).collect()
    want = {(w, t): r for w in set(words) if w and len(w) >= 6 and w not in terms for t in set(terms) if len(t) >= 6 and abs(len(w) - len(t)) <= 2 and (r := SequenceMatcher(None, w, t).ratio()) >= least}
    assert {(r["word"], r["term"]): r["ratio"] for r in got} == want and len(want) > 50


@pytest.mark.parametrize("lists, part", [(4096, 20_000), (3, 7)])
def test_as_of_index_equals_brute_force(spark, monkeypatch, lists, part):
    import numpy as np

    monkeypatch.setattr(vectors, "LISTS", lists)
    monkeypatch.setattr(vectors, "PART", part)
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(6, 8))
    v = np.concatenate([centers[i % 6] + 0.2 * rng.normal(size=8) for i in range(240)] + [centers[0]] * 60).reshape(-1, 8)
    seen = [date(2024, 1, 1 + int(x)) for x in rng.integers(0, 28, len(v))]
    rows = [(f"k{i:03d}", x.tolist(), d) for i, (x, d) in enumerate(zip(v, seen))] + [("none", None, date(2024, 1, 1)), ("never", v[0].tolist(), None)]
    index = vectors.AsOfIndex(spark.createDataFrame(rows, "key string, embedding array<double>, first_seen date"))
    asked = [(q, date(2024, 1, d), v[q].tolist()) for q in (0, 1, 50, 250, 299) for d in (1, 2, 15, 31)] + [(7, None, v[7].tolist()), (8, date(2024, 1, 9), None)]
    got = index.nearest(spark.createDataFrame(asked, "query long, as_of date, embedding array<double>"), 9).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {}
    for q, d, e in asked:
        if d and e:
            order = sorted((-round(float(u[i] @ u[q]), 9), f"k{i:03d}") for i in range(len(v)) if seen[i] < d)[:9]
            want |= {(q, d, key): r for r, (_, key) in enumerate(order, 1)}
    assert {(r["query"], r["as_of"], r["key"]): r["rank"] for r in got} == want


def test_breaker_skips_while_it_cools_and_probes_from_zero(spark):
    from datetime import datetime, timedelta

    from lotlight.streaming import breaker

    start = datetime(2024, 1, 1)
    kinds = [(0, "error"), (10, "error"), (20, "view"), (800, "error"), (909, "error"), (910, "error"), (920, "view"), (930, "error"), (940, "error"), (950, None)]
    rows = [(i, 1, start + timedelta(seconds=s), k) for i, (s, k) in enumerate(kinds)] + [(50, None, start, "error"), (51, None, start, "error"), (52, 2, None, "error"), (53, 2, start, "error")]
    got = breaker.calls(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string").repartition(3)).collect()
    want = "FAILED FAILED SKIPPED SKIPPED SKIPPED FAILED ANSWERED FAILED FAILED SKIPPED".split()
    by = {r["event_id"]: (r["outcome"], r["opens"]) for r in got}
    assert [by[i][0] for i in range(10)] == want and [i for i in by if by[i][1]] and {i for i in by if by[i][1]} == {1, 8, 51, 53}
