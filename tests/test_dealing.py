"""How queries deal their work over tasks, and that they do no step twice."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lotlight import plans, session
from lotlight.operators import resolver, search

ROOT = "/root/testdata/sf0.001"


def test_first_dates_of_pairs_are_dealt_by_the_number_of_lines(spark, monkeypatch, capsys):
    """A lot's pairs of supplier and code are the longest table: more lines, more tasks for them."""
    monkeypatch.setattr(session, "ROWS", 200)
    n = -(-spark.read.parquet(f"{ROOT}/lineitem.parquet").count() // 200)
    plans.QUERIES["replay_difficulty"](spark, ROOT).explain()
    told = capsys.readouterr().out
    for key in ("code_group", "customer"):
        assert re.search(rf"hashpartitioning\(supplier_id#\d+L?, {key}#\d+L?, {n}\), REPARTITION_BY_NUM", told)


def test_known_suppliers_come_with_the_concentration(spark, capsys):
    """Pools are counted once: the lines are read for codes, for relations and for the support."""
    plans.QUERIES["market_intelligence"](spark, ROOT).explain()
    assert len(re.findall(r"FileScan parquet \[l_orderkey", capsys.readouterr().out)) == 3


@pytest.mark.parametrize("name", ["batch_selection", "replay_sample"])
def test_a_task_takes_a_quarter_of_a_million_lines(spark, monkeypatch, name):
    """Hash tables and sorts of a task's lots stay small at every size (given rows stand for a thousand each)."""
    monkeypatch.setattr(session, "ROWS", session.ROWS // 1000)
    made, spread = [], session.spread
    monkeypatch.setattr("lotlight.sources.canonical.spread", lambda df, rows, *keys: made.append(spread(df, rows, *keys).rdd.getNumPartitions()) or spread(df, rows, *keys))
    plans.QUERIES[name](spark, ROOT)
    lines = spark.read.parquet(f"{ROOT}/lineitem.parquet").count()
    assert made and min(made) >= lines * 1000 // 250_000


def test_equal_texts_are_resolved_once_and_dealt_by_their_pairs(spark, monkeypatch):
    """What is dealt are the pairs of distinct texts and titles, however many queries ask."""
    dealt = []
    monkeypatch.setattr(resolver, "spread", lambda df, rows, *keys: dealt.append(rows) or session.spread(df, rows, *keys), raising=False)
    titles = spark.createDataFrame([("c1", "red bolt"), ("c2", "red ring"), ("c3", "blue ring"), ("c4", "red bolt")], "code string, title string")
    texts = ["red bolt", "red ring", "Blue", "green", None]
    asked = spark.createDataFrame([(i, texts[i % 5]) for i in range(50)], "query long, text string")
    got = {r["query"]: (r.code, r.found_by, r.decision) for r in resolver.resolve(asked, titles).collect()}
    want = [("c1", "exact", "AMBIGUOUS"), ("c2", "exact", "RESOLVED"), ("c3", "terms", "RESOLVED"), (None, "none", "UNCERTAIN"), (None, "none", "UNCERTAIN")]
    assert [got[i] for i in range(50)] == [want[i % 5] for i in range(50)]
    # red is in 3 titles, bolt and ring in 2, blue in 1: 5 pairs of two texts, one of the third
    assert dealt == [3 + 2 + 3 + 2 + 1]


def test_only_texts_that_can_give_a_first_item_meet_their_items(spark):
    """A key's texts below enough items of better ones bring no items; ties stay whole."""
    met = [("a", "t1", 1.0, 2), ("a", "t2", 0.5, 1), ("a", "t3", 0.5, 9), ("a", "t4", 0.25, 1), ("b", "t1", 1.0, 3), ("b", "t4", 0.25, 1)]
    met = spark.createDataFrame(met, "key string, text string, score double, n long")
    assert sorted((r.key, r.text) for r in search.leading_texts(met, 3).collect()) == [("a", "t1"), ("a", "t2"), ("a", "t3"), ("b", "t1")]


def test_equal_texts_suggest_codes_once(spark):
    """Queries of one text share its codes, and no branch of codes is searched for them."""
    goods = [(lot, lot % 4, 1, f"2024-01-{1 + lot % 9:02d}", f"{'red blue'.split()[lot % 2]} b{lot % 3}-10", f"c.{lot % 4}" if lot % 4 else None) for lot in range(60)]
    struct = F.struct(F.col("c").alias("code"), *[F.lit(None).cast("string").alias(x) for x in ("class", "subclass", "group", "subgroup", "kind")])
    items = spark.createDataFrame(goods, "lot_id long, part long, line int, d string, text string, c string").select("lot_id", "part", "line", F.to_date("d").alias("publish_date"), "text", struct.alias("code"))
    texts = ["red b0-10", "blue b1-10", None, "nothing"]
    asked = spark.createDataFrame([(q, texts[q % 4]) for q in range(40)], "query long, text string")
    got = {}
    for r in search.suggest(asked, search.Catalogue.of(items)).collect():
        got.setdefault(r["query"], []).append((r.place, r.code, r["items"], r.lots, r.support))
    # red: even lots, so parts 0 (no code) and 2; blue: odd lots, parts 1 and 3
    same = lambda lot, q: {0: (lot % 2 == 0) + (lot % 3 == 0), 1: (lot % 2 == 1) + (lot % 3 == 1)}[q] == 2
    for q in (0, 1):
        exact = {f"c.{k}": sum(same(lot, q) and lot % 4 == k for lot in range(60)) for k in (1, 2, 3)}
        mine = {code: n for _, code, n, _, _ in got[q]}
        assert all(mine.get(code, 0) >= n for code, n in exact.items()) and sum(exact.values())
    assert all(got.get(q) == got.get(q % 4) for q in range(40)) and set(got) == {q for q in range(40) if q % 4 < 2}
