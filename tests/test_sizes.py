"""Queries on tables unlike the given ones, against their twins."""

from datetime import date, timedelta

import duckdb
from pyspark.sql import functions as F

from lotlight import plans, session
from lotlight.operators import asof, search, vectors
from lotlight.sources import canonical

ROOT = "/root/testdata/sf0.001"


def rows(df, twin):
    """The query's and the twin's rows, by the query's columns."""
    at = [twin.columns.index(c) for c in df.columns]
    return sorted((tuple(r) for r in df.collect()), key=str), sorted((tuple(r[i] for i in at) for r in twin.fetchall()), key=str)


def test_tax_numbers_of_large_keys(spark, tmp_path):
    """Keys past the number range: the number is short, so nine digits are its own."""
    spark.range(631_000, 633_000).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.sql(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    got, want = rows(plans.QUERIES["tax_numbers"](spark, str(tmp_path)), con.sql(plans.SQL["tax_numbers"]))
    assert got == want


def test_prefix_categories_count_names(spark, tmp_path):
    names = [("SMALL", "small box"), ("SMALL", "mall"), ("SMALL", "mall mall"), ("STANDARD", "a\nmall"), ("STANDARD", None), ("LARGE", "small")]
    spark.createDataFrame(names, "p_type string, p_name string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    got, want = rows(plans.QUERIES["prefix_categories"](spark, str(tmp_path)), con.sql(plans.SQL["prefix_categories"]))
    assert got == want == [("SMALL", 3, 2), ("STANDARD", 2, 1)]


def test_lots_are_dealt_by_the_number_of_lines(spark, monkeypatch):
    """More lines, more tasks, whatever adaptive execution would join."""
    monkeypatch.setattr(session, "ROWS", 200)
    n = spark.read.parquet(f"{ROOT}/lineitem.parquet").count()
    for view in (canonical.relations, canonical.items):
        assert view(spark, ROOT).rdd.getNumPartitions() >= n // 200


def test_members_by_earlier_events_in_blocks(spark):
    """The best members of each query are those of the counts before its date,
    ties to the smaller member, however members and queries are dealt."""
    day = lambda n: date(2024, 1, 1) + timedelta(n)
    events = [("abc"[i % 3], i * i % 17, day(i * 7 % 20)) for i in range(400)] + [("z", 1, day(0)), (None, 1, day(0)), ("a", 2, None), ("a", None, day(0))]
    asked = [(q, g, day(q % 21)) for q in range(30) for g in ("ab" if q % 2 else "c")] + [(31, "nowhere", day(9)), (32, "a", None)]
    events, asked = spark.createDataFrame(events, "g string, m long, publish_date date"), spark.createDataFrame(asked, "query long, g string, as_of date")
    votes = asked.join(asof.counts_before(events.dropna(subset=["g", "m"]), asked, "g", "m"), ["g", "as_of"]).groupBy("query", "m").agg(F.sum("n").alias("n"))
    want = sorted(map(tuple, search.top(votes, "query", [F.desc("n"), "m"], 4).select("query", "m", "n").collect()))
    assert len(want) > 80
    for blocks, slices in ((1, 1), (3, 2), (40, 5)):
        assert sorted(map(tuple, asof.most_before(events, asked, "g", "m", 4, blocks, slices).select("query", "m", "n").collect())) == want


def test_lots_are_scored_where_their_matrix_lies(spark, capsys):
    """A lot's subject comes with the matrix, so scoring moves no row of it."""
    matrix = spark.createDataFrame([(50, 1, date(1999, 1, 1), [0.5, None], [1.0, None], 0.5, 1, 7, 0.25), (50, 2, date(1999, 1, 1), [1.0, 0.0], [None, None], 1.0, 1, 8, None)], search.MATRIX)
    lots = search.lot_scores(matrix)
    got = {r.lot_id: r for r in lots.collect()}
    assert abs(got[1].relevance - (0.6 * 0.5 + 0.3 * 1.0 + 0.1 * 0.25) / 1.0) < 1e-9
    assert abs(got[2].relevance - 0.5) < 1e-9 and got[2].subject == 0.0
    lots.explain()
    assert "Exchange" not in capsys.readouterr().out


def test_items_are_packed_once_for_each_text_or_code_that_asks(spark):
    """A key's hits are one row, items of equal text and code in one entry, whatever number of queries takes them."""
    code = "struct<code:string,path:array<string>,deepest:int>"
    items = [(lot, lot % 4, date(2024, 1, 1), f"t{lot % 2}", ("c.b", ["c"], 0) if lot % 4 else None, f"s{lot}") for lot in range(40)]
    items = spark.createDataFrame(items, f"lot_id long, part long, publish_date date, text string, path {code}, subject string")
    hits = items.selectExpr("'text' kind", "'a' key", "lot_id", "part").unionByName(items.filter("lot_id < 3").selectExpr("'code' kind", "'a' key", "lot_id", "part"))
    got = {r.kind: r.hits for r in search.packed(hits, items).collect()}
    assert sorted((h.text, h.path.code, len(h.lots)) for h in got["text"] if h.path and h.path.code) == [("t0", "c.b", 10), ("t1", "c.b", 20)] and len(got["text"]) == 3
    assert sorted(lot for h in got["text"] for lot in h.lots) == list(range(40)) and sorted(lot for h in got["code"] for lot in h.lots) == [0, 1, 2]
    assert all(h.parts[i] == lot % 4 and h.subjects[i] == f"s{lot}" and h.text == f"t{lot % 2}" for h in got["text"] for i, lot in enumerate(h.lots))


def test_nearest_vectors_in_slices(spark, monkeypatch):
    """A task holds one slice's cosines at a time, and ties across slices still go to the smaller id."""
    import random

    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(300)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = {}
    for size in (1024, 7):
        monkeypatch.setattr(vectors, "SLICE", size)
        got[size] = sorted((r["query"], r.place, r.vec_id) for r in vectors.nearest(v, v.filter("vec_id % 10 = 0"), 4).collect())
    assert got[7] == got[1024] and len(got[7]) == 120


def test_newest_items_are_cut_before_queries_meet_them(spark, monkeypatch):
    """A text's newest items are the same for every query that found it, by few dates and by many."""
    day = lambda n: date(2024, 1, 1) + timedelta(n)
    texts = spark.createDataFrame([("a",), ("b",)], "text string").withColumn("key", F.md5("text"))
    goods = [(i, i % 3, "ab"[i % 2], day(i % 9)) for i in range(60)]
    items = spark.createDataFrame(goods, "lot_id long, part long, text string, publish_date date")
    asked = [(q, t, day(d)) for q in range(5) for t in "ab" for d in (0, 4, 20)]
    found = spark.createDataFrame(asked, "query long, text string, as_of date").select("query", "as_of", F.md5("text").alias("key"), F.lit(0.5).alias("cosine"), F.lit(1).alias("rank"))
    want = sorted((q, d, g[0], g[1]) for q, t, d in asked for g in sorted((g for g in goods if g[2] == t and g[3] < d), key=lambda g: (-g[3].toordinal(), g[0], g[1]))[:5])
    for dates in (16, 0):
        monkeypatch.setattr(vectors, "DATES", dates)
        out = vectors.newest_items(found, texts, items, 5)
        assert sorted((r["query"], r.as_of, r.lot_id, r.part) for r in out.collect()) == want


def test_documents_of_tokens_by_their_words(spark):
    """Tokens inside words, repeated words and documents, wildcards, other white space: as plain contains says."""
    space = r"[\x20\x09-\x0D]"
    texts = ["a10%b x_1", "a10%b a10%b\ta10%b", "x_1 #tag#tag", "10% off", "", " a 10 ", "xx_1x\n#ta g"]
    tokens = ["10%", "x_1", "#tag", "_1 #", "a10%b", "zzz", "10", "a 10"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    found = search.documents_with(spark.createDataFrame([(t,) for t in tokens], "token string"), docs, "doc_id", space)
    want = sorted((t, i) for t in tokens if len(t) >= 3 and " " not in t for i, x in enumerate(texts) if t in x)
    assert sorted((r.token, r.doc_id) for r in found.collect()) == want and len(want) == 10


def test_a_ranking_is_computed_once_for_its_evidence(spark):
    """Evidence reads the ranking twice, but the search behind it runs once."""
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    ranked = spark.sql("select id % 3 query, id supplier_id, int(id) rank, array(named_struct('nth', 1, 'lot_id', id, 'part', 2L)) evidence from range(12)")
    products = spark.createDataFrame([(2, "t", ("c",))], "part long, text string, code struct<code:string>")
    out = search.with_evidence(ranked.mapInArrow(counted, ranked.schema), products).collect()
    assert len(out) == 12 and all(r.best_products == ["t"] and r.best_code == "c" for r in out)
    assert runs.value == 12


def test_packed_rows_travel_once_a_block(spark, monkeypatch):
    """Compressed rows come back as they were, and queries of one block share them: the same matrix by one block and by many."""
    sf = "/root/testdata/sf0.001"
    sent, plain = [], search.squeezed
    monkeypatch.setattr(search, "squeezed", lambda hits: sent.append(hits) or plain(hits))
    items = session.written(canonical.product_items(spark, sf))
    catalogue = search.Catalogue.of(items)
    asked = session.written(items.filter("lot_id % 50 = 0 and line <= 2").select(F.col("lot_id").alias("query"), F.col("line").alias("no"), "text", "code").dropDuplicates(["query", "no"]))
    got = {}
    for n in (search.ITEMS, 1):
        monkeypatch.setattr(search, "ITEMS", n)
        matrix = search.match_matrix(asked, catalogue)
        assert n > 1 or matrix.rdd.getNumPartitions() == asked.count() > 8
        got[n] = sorted(map(str, matrix.collect()))
    assert len(got) == 2 and len(set(map(str, got.values()))) == 1 and len(got[1]) > 100
    row = search.packed(search.branch_hits(asked, catalogue)[0].select(F.lit("text").alias("kind"), "key", "lot_id", "part"), items.select("lot_id", "part", "publish_date", "text", search.scalars.okpd2_path(F.col("code")).alias("path"), F.lit(None).cast("string").alias("subject"))).limit(1)
    back = plain(row).toArrow()
    numbers, texts, codes, subjects = search._restored(back["squeezed"].combine_chunks()[0].as_buffer(), back["size"][0].as_py())
    assert subjects == [] or subjects == [None]
    assert len(numbers["lot"]) == numbers["times"].sum() and len(texts) == len(numbers["times"]) == len(numbers["code"])
    assert len(sent) == 2


def test_lots_beyond_the_limit_are_left_out_of_the_matrix(spark):
    """The first lots by relevance are those of the whole matrix."""
    sf = "/root/testdata/sf0.001"
    items = session.written(canonical.product_items(spark, sf))
    catalogue = search.Catalogue.of(items)
    asked = session.written(items.filter("lot_id % 50 = 0 and line <= 2").select(F.col("lot_id").alias("query"), F.col("line").alias("no"), "text", "code").dropDuplicates(["query", "no"]))
    queries = asked.groupBy("query").agg(F.min("text").alias("subject"))
    first = lambda m: sorted((r["query"], r.lot_id, r.relevance) for r in search.top(search.lot_scores(m), "query", [F.desc("relevance"), F.desc("publish_date"), "lot_id"], 20).collect())
    whole = search.match_matrix(asked, catalogue, search.Config(), queries, canonical.subjects(items))
    cut = search.match_matrix(asked, catalogue, search.Config(), queries, canonical.subjects(items), 20)
    assert first(whole) == first(cut) and cut.count() < whole.count()


def test_places_of_wanted_members_equal_a_whole_ranking(spark, monkeypatch):
    """By one bucket and slice or many, for each history: the places of ``most_before``'s order."""
    day = lambda n: date(2024, 1, 1) + timedelta(n)
    events = [("abcd"[i % 4], i * i % 23 * 3, day(i * 7 % 20), i % 3 == 0) for i in range(600)] + [(None, 1, day(0), True), ("a", 2, None, True), ("a", None, day(0), True)]
    asked = [(q, g, day(q % 21)) for q in range(40) for g in ("ab" if q % 2 else "c")] + [(41, "nowhere", day(9)), (42, "a", None)]
    wanted = [(q, m) for q in range(43) for m in {q % 23 * 3, q * 5 % 23 * 3, 99}] + [(50, 3), (None, 3), (1, None)]
    want = []
    for h in range(2):
        for q in range(40):
            mine, at = {g for x, g, _ in asked if x == q}, day(q % 21)
            n = {}
            for g, m, d, won in events:
                if g in mine and m is not None and d is not None and d < at and (won or h):
                    n[m] = n.get(m, 0) + 1
            order = sorted(n, key=lambda m: (-n[m], m))[:6]
            want += [(h, q, m, order.index(m) + 1) for x, m in wanted if x == q and m in order]
    assert len(want) > 20
    frames = spark.createDataFrame(events, "g string, m long, publish_date date, won boolean").withColumn("seen", F.lit(True)), spark.createDataFrame(asked, "query long, g string, as_of date"), spark.createDataFrame(wanted, "query long, m long")
    for buckets, slices, width in ((1, 1, 2048), (3, 4, 2), (5, 50, 1)):
        monkeypatch.setattr(asof, "WIDTH", width)
        got = asof.ranks_before(*frames, "g", "m", ["won", "seen"], 6, buckets, slices)
        assert sorted(map(tuple, got.select("history", "query", "m", "rank").collect())) == sorted(want)


def test_the_replay_measures_every_target(spark):
    """All eligible lots, not only those of every fiftieth key."""
    n = plans.QUERIES["replay_targets"](spark, "/root/testdata/sf0.001").count()
    assert sum(r.queries for r in plans.QUERIES["replay_breakdown"](spark, "/root/testdata/sf0.001").collect()) == n > 100
    assert "% 50" not in plans.SQL["replay_breakdown"] and "% 50" not in plans.SQL["challenger_acceptance"]


def test_every_part_is_resolved(spark):
    n = spark.read.parquet(f"{ROOT}/part.parquet").count()
    assert plans.QUERIES["category_resolution"](spark, ROOT).count() == n
