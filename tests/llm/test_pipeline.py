import corpus_pipeline
from lotlight.llm import queries

ROOT = "/root/testdata/sf0.001"


def test_stages_and_registry():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    assert {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in queries.queries()}
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_each_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    extra = docs.limit(1).selectExpr("doc_id + 100000 as doc_id", "'12 34' as text", "lang", "source", "n_chars")
    near = docs.limit(1).selectExpr("doc_id + 200000 as doc_id", "concat(text, ' end') as text", "lang", "source", "n_chars")
    item = spark.read.parquet(f"{ROOT}/benchmark.parquet").filter("item_id = 0").selectExpr("300000L as doc_id", "concat('The and of to in ', text) as text", "'en' as lang", "'s' as source", "1L as n_chars")
    mail = docs.limit(1).selectExpr("400000L as doc_id", "'The thing and of the other in the house is for mail to bob@mail1.example.com' as text", "'en' as lang", "source", "n_chars")
    at = docs.unionByName(extra).unionByName(near).unionByName(item).unionByName(mail)
    from lotlight.llm.shared import cut

    at = cut(at)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    seen = [ids(at)]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, at, ROOT))
        assert out.columns == docs.columns
        seen.append(ids(out))
        at = out
    assert 100000 in seen[0] - seen[1] and 200000 in seen[1] - seen[2] and 300000 in seen[2] - seen[3] and 400000 in seen[4]
    assert len(seen[1]) > 0.98 * len(seen[0])
    text = at.filter("doc_id = 400000").first().text
    assert "bob@" not in text and "@" in text
    packed = corpus_pipeline.STAGES[-1][1](spark, at, ROOT)
    assert ids(packed) == seen[4]


def test_near_duplicate_stage_drops_rows_not_ids(spark):
    from lotlight.llm.shared import cut

    text, other = "one two three four five six seven eight nine ten", "some quite different words that are in no other document here"
    rows = [(7, text, 1), (3, text, 2), (7, other, 3), (None, "null id " + other * 2, 4), (9, None, 5), (9, "", 6), (5, "again again and again five", 7), (5, "again again and again five", 8)]
    docs = cut(spark.createDataFrame(rows, "doc_id long, text string, _row int"))
    out = corpus_pipeline.STAGES[1][1](spark, docs, ROOT)
    assert out.columns == docs.columns
    kept = {r._row for r in out.collect()}
    assert {2, 3, 4, 5, 6} <= kept and 1 not in kept and len(kept & {7, 8}) == 1
    assert corpus_pipeline.STAGES[1][1](spark, cut(docs.filter("false")), ROOT).count() == 0
