"""Replay queries: targets, difficulty, leakage, metrics."""

from __future__ import annotations

import math
import re
from datetime import date

from pyspark.sql import functions as F

from ..operators import asof, evaluation, resample, search
from ..session import table, written
from ..sources import canonical
from .registry import query

#: Lines and suppliers of a block of the replay's votes; a line makes some five events.
EVENTS, MEMBERS = 1_500_000, 8192
#: Targets of a slice of the whole replay.
TARGETS = 200_000

START, END = date(1999, 1, 1), date(2000, 12, 31)

_ELIGIBLE = """r AS (SELECT lot_id, publish_date, count(*) AS n_relations, count(*) FILTER (WHERE is_winner) AS n_winners FROM relations WHERE platform = 'EM' AND publish_date BETWEEN DATE '1999-01-01' AND DATE '2000-12-31' GROUP BY 1, 2),
 t AS (SELECT lot_id, count(*) AS n_items, count(DISTINCT code) AS n_codes, CASE WHEN count(DISTINCT code_class) = 1 THEN min(code_class) ELSE 'MULTI' END AS stratum FROM items GROUP BY 1),
 e AS (SELECT * FROM r JOIN t USING (lot_id) WHERE n_winners >= 1 AND n_relations >= 2)"""


def _eligible(spark, sf_dir):
    return evaluation.eligible(canonical.relations(spark, sf_dir), canonical.items(spark, sf_dir), START, END)


@query("WITH " + _ELIGIBLE + " SELECT * FROM e", "lots relations items")
def replay_targets(spark, sf_dir):
    return _eligible(spark, sf_dir)


@query()
def replay_sample(spark, sf_dir):
    """A stratified sample of targets by root-proportional allocation."""
    return evaluation.stratified(_eligible(spark, sf_dir).select("lot_id", "publish_date", "stratum"), 300, 20)


@query(
    "WITH " + _ELIGIBLE + """, w AS (SELECT x.lot_id, x.supplier_id, e.publish_date AS as_of, l.customer FROM relations x JOIN e ON e.lot_id = x.lot_id JOIN lots l ON l.lot_id = x.lot_id WHERE x.is_winner),
 fa AS (SELECT supplier_id, min(publish_date) AS d FROM relations GROUP BY 1), fc AS (SELECT supplier_id, customer, min(x.publish_date) AS d FROM relations x JOIN lots USING (lot_id) GROUP BY 1, 2),
 ck AS (SELECT DISTINCT lot_id, code, code_group FROM items), fk AS (SELECT supplier_id, code, min(publish_date) AS d FROM relations JOIN ck USING (lot_id) GROUP BY 1, 2), fg AS (SELECT supplier_id, code_group, min(publish_date) AS d FROM relations JOIN ck USING (lot_id) GROUP BY 1, 2),
 a AS (SELECT w.lot_id, bool_or(fa.d < as_of) AS anywhere, bool_or(fc.d < as_of) AS same_customer FROM w JOIN fa USING (supplier_id) JOIN fc ON fc.supplier_id = w.supplier_id AND fc.customer = w.customer GROUP BY 1),
 k AS (SELECT w.lot_id, bool_or(fk.d < as_of) AS same_code, bool_or(fg.d < as_of) AS same_group FROM w JOIN ck ON ck.lot_id = w.lot_id JOIN fk ON fk.supplier_id = w.supplier_id AND fk.code = ck.code JOIN fg ON fg.supplier_id = w.supplier_id AND fg.code_group = ck.code_group GROUP BY 1)
 SELECT a.lot_id, anywhere, same_customer, same_code, same_group, CASE WHEN same_code THEN 'EASY' WHEN same_group THEN 'MEDIUM' ELSE 'HARD' END AS difficulty FROM a JOIN k USING (lot_id)""",
    "lots relations items",
)
def replay_difficulty(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").count()
    return evaluation.difficulty(_eligible(spark, sf_dir), canonical.relations(spark, sf_dir), canonical.lots(spark, sf_dir), canonical.items(spark, sf_dir), lines)


@query(
    """WITH p AS (SELECT supplier_id, publish_date, count(*) AS same_day FROM relations GROUP BY 1, 2) SELECT supplier_id, publish_date, CAST(coalesce(sum(same_day) OVER (PARTITION BY supplier_id ORDER BY publish_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, same_day,
 CAST(coalesce(sum(same_day) OVER (PARTITION BY supplier_id ORDER BY publish_date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS after FROM p""",
    "lots relations",
)
def leakage_probe(spark, sf_dir):
    return evaluation.leakage(canonical.relations(spark, sf_dir))


_REPLAY = (
    "WITH " + _ELIGIBLE + """, target AS (SELECT lot_id AS query, publish_date AS as_of, code_group FROM e JOIN (SELECT DISTINCT lot_id, code_group FROM items) USING (lot_id) WHERE lot_id % 50 = 0),
 hist AS (SELECT DISTINCT i.code_group, x.lot_id, x.supplier_id, x.publish_date FROM relations x JOIN items i ON i.lot_id = x.lot_id WHERE is_winner),
 votes AS (SELECT query, supplier_id, count(*) AS n FROM target JOIN hist USING (code_group) WHERE hist.publish_date < as_of GROUP BY 1, 2),
 ranked AS (SELECT query, supplier_id, row_number() OVER (PARTITION BY query ORDER BY n DESC, supplier_id) AS rank FROM votes),
 rel AS (SELECT lot_id AS query, supplier_id, CASE WHEN is_winner THEN 2 ELSE 1 END AS grade FROM relations WHERE lot_id IN (SELECT query FROM target)),
 b AS (SELECT rel.*, rank, row_number() OVER (PARTITION BY rel.query ORDER BY grade DESC, rel.supplier_id) AS ideal FROM rel LEFT JOIN (SELECT * FROM ranked WHERE rank <= 50) k ON k.query = rel.query AND k.supplier_id = rel.supplier_id),
 m AS (SELECT query, count(*) FILTER (WHERE grade = 2 AND rank <= 10) / count(*) FILTER (WHERE grade = 2) AS winner_recall, count(*) FILTER (WHERE rank <= 10) / count(*) AS observed_recall, coalesce(1 / min(CASE WHEN grade = 2 THEN rank END), 0) AS mrr,
 round(coalesce(sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) END), 0) / sum(CASE WHEN ideal <= 10 THEN (pow(2, grade) - 1) / log2(ideal + 1) END), 9) AS ndcg FROM b GROUP BY 1)"""
)


def _replayed(spark, sf_dir):
    """Metrics of the ranking by earlier awards for the replay's queries, every fiftieth lot's."""
    rel, items = canonical.relations(spark, sf_dir), canonical.items(spark, sf_dir)
    groups = items.select("lot_id", "code_group").distinct()
    targets = _eligible(spark, sf_dir).filter("lot_id % 50 = 0").select(F.col("lot_id").alias("query"), F.col("publish_date").alias("as_of"))
    asked = targets.join(groups.withColumnRenamed("lot_id", "query"), "query")
    won = rel.filter("is_winner").select("lot_id", "supplier_id", "publish_date").join(groups, "lot_id")
    # numbers of tables, from their footers, deal the work; every fiftieth lot asks at most
    size = lambda name: table(spark, sf_dir, name).count()
    blocks = max(spark.sparkContext.defaultParallelism, math.ceil(size("lineitem") / EVENTS), math.ceil(size("supplier") / MEMBERS))
    votes = asof.most_before(won, asked, "code_group", "supplier_id", 50, blocks, math.ceil(size("orders") / 50 / asof.SLICE) or 1)
    ranked = search.top(votes, "query", [F.desc("n"), "supplier_id"], 50, "rank")
    relevant = rel.withColumnRenamed("lot_id", "query").join(targets.select("query"), "query", "left_semi").select("query", "supplier_id", F.when(F.col("is_winner"), 2).otherwise(1).alias("grade"))
    return evaluation.metrics(ranked, relevant)


#: The same for every target, not only those of every fiftieth lot.
_WHOLE = _REPLAY.replace(" USING (lot_id) WHERE lot_id % 50 = 0)", " USING (lot_id))")


def _measured(spark, sf_dir, histories):
    """All targets, and for each history (name and condition on relations) the
    metrics of the ranking by it; one pass over the events serves all."""
    rel, items = canonical.relations(spark, sf_dir), canonical.items(spark, sf_dir)
    groups = items.select("lot_id", "code_group").distinct()
    targets = written(_eligible(spark, sf_dir).select(F.col("lot_id").alias("query"), F.col("publish_date").alias("as_of"), "stratum"))
    relevant = rel.withColumnRenamed("lot_id", "query").join(targets.select("query"), "query", "left_semi")
    relevant = written(relevant.select("query", "supplier_id", F.when(F.col("is_winner"), 2).otherwise(1).alias("grade")))
    asked = targets.select("query", "as_of").join(groups.withColumnRenamed("lot_id", "query"), "query")
    events = rel.select("lot_id", "supplier_id", "publish_date", *[F.expr(h).alias(name) for name, h in histories.items()]).join(groups, "lot_id")
    buckets = math.ceil(table(spark, sf_dir, "supplier").count() / MEMBERS) or 1
    slices = max(spark.sparkContext.defaultParallelism, math.ceil(targets.count() / TARGETS))
    ranked = written(asof.ranks_before(events, asked, relevant, "code_group", "supplier_id", list(histories), 50, buckets, slices))
    return targets, {name: evaluation.metrics(ranked.filter(F.col("history") == i).drop("history"), relevant) for i, name in enumerate(histories)}


@query(_REPLAY + " SELECT * FROM m", "lots relations items")
def replay_metrics(spark, sf_dir):
    """A baseline by earlier awards in the same groups, measured on targets."""
    return _replayed(spark, sf_dir)


@query(_WHOLE + ", u AS (SELECT m.*, e.stratum FROM m JOIN e ON e.lot_id = m.query) SELECT stratum, count(*) AS queries, round(avg(winner_recall), 9) AS winner_recall, round(avg(mrr), 9) AS mrr, round(avg(ndcg), 8) AS ndcg FROM u GROUP BY 1", "lots relations items")
def replay_breakdown(spark, sf_dir):
    """Mean metrics of the baseline over all targets of each stratum."""
    targets, measured = _measured(spark, sf_dir, {"won": "is_winner"})
    m = measured["won"]
    mean = lambda c, d: F.round(F.avg(c), d).alias(c)
    return m.join(targets.select("query", "stratum"), "query").groupBy("stratum").agg(F.count("*").alias("queries"), mean("winner_recall", 9), mean("mrr", 9), mean("ndcg", 8))


@query(
    """WITH w AS (SELECT year(publish_date) AS year, supplier_id, count(*) AS n FROM relations WHERE is_winner GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, supplier_id) AS place FROM w),
 a AS (SELECT supplier_id FROM p WHERE year = 1998 AND place <= 30), b AS (SELECT supplier_id FROM p WHERE year = 1999 AND place <= 30)
 SELECT supplier_id, CASE WHEN a.supplier_id IS NOT NULL AND b.supplier_id IS NOT NULL THEN 'KEPT' WHEN a.supplier_id IS NOT NULL THEN 'LOST' ELSE 'RECOVERED' END AS movement FROM a FULL JOIN b USING (supplier_id)""",
    "lots relations",
)
def winner_pool_movement(spark, sf_dir):
    won = canonical.relations(spark, sf_dir).filter("is_winner").groupBy(F.year("publish_date").alias("year"), "supplier_id").agg(F.count("*").alias("n"))
    best = search.top(won, "year", [F.desc("n"), "supplier_id"], 30)
    return evaluation.movement(best.filter("year = 1998"), best.filter("year = 1999"), ["supplier_id"])


@query(
    "WITH " + _ELIGIBLE + """, c(check_name, failures) AS (SELECT 'no winner', (SELECT count(*) FROM e WHERE n_winners < 1) UNION ALL SELECT 'too few relations', (SELECT count(*) FROM e WHERE n_relations < 2)
 UNION ALL SELECT 'wrong platform', (SELECT count(*) FROM e JOIN lots USING (lot_id) WHERE platform <> 'EM') UNION ALL SELECT 'outside period', (SELECT count(*) FROM e WHERE publish_date NOT BETWEEN DATE '1999-01-01' AND DATE '2000-12-31')
 UNION ALL SELECT 'repeated lot', (SELECT count(*) - count(DISTINCT lot_id) FROM e) UNION ALL SELECT 'items without code', (SELECT count(*) FROM e WHERE n_codes = 0)) SELECT * FROM c""",
    "lots relations items",
)
def replay_integrity(spark, sf_dir):
    """Checks of the target table; each counts its failures."""
    e = _eligible(spark, sf_dir).join(canonical.lots(spark, sf_dir).select("lot_id", "platform"), "lot_id")
    rules = {
        "no winner": F.count_if(F.col("n_winners") < 1), "too few relations": F.count_if(F.col("n_relations") < 2), "wrong platform": F.count_if(F.col("platform") != "EM"),
        "outside period": F.count_if(~F.col("publish_date").between(F.lit(START), F.lit(END))), "repeated lot": F.count("*") - F.countDistinct("lot_id"), "items without code": F.count_if(F.col("n_codes") == 0),
    }
    one = e.agg(*[c.alias(n) for n, c in rules.items()])
    return one.unpivot([], list(rules), "check_name", "failures")


def _other(name: str, history: str) -> str:
    """The twin's ranking and metrics once more over other history."""
    again = re.sub(r"\b(hist|votes|ranked|rel|b|m)\b", rf"\1_{name}", _REPLAY[_REPLAY.index(" hist AS") :])
    return again.replace("WHERE is_winner)", f"WHERE {history})")


#: Challengers of the ranking by earlier awards, by the history that they count.
CHALLENGERS = {"large": "is_winner AND platform = 'EM'", "seen": "true"}
RESAMPLES = 500


@query(
    _WHOLE + "," + ",".join(_other(n, h.replace("platform", "x.platform")) for n, h in CHALLENGERS.items())
    + ", t0 AS (SELECT DISTINCT query, e.stratum FROM target JOIN e ON e.lot_id = query), wt AS (SELECT t.stratum, round(n / count(*), 4) AS weight FROM t0 t JOIN (SELECT stratum, count(*) AS n FROM e GROUP BY 1) USING (stratum) GROUP BY 1, n), d AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS challenger, query, stratum, CAST(round(weight * 10000) AS BIGINT) AS w, CAST(round((c.ndcg - m.ndcg) * 1000000) AS BIGINT) AS v, CAST(round((c.winner_recall - m.winner_recall) * 1000000) AS BIGINT) AS r FROM m_{n} c JOIN m USING (query) JOIN t0 USING (query) JOIN wt USING (stratum)" for n in CHALLENGERS)
    + f"), s AS (SELECT d.*, b, ('0x' || substr(md5('7:' || query || ':' || b), 1, 8))::UBIGINT AS h FROM d, range(0, {RESAMPLES + 1}) x(b)), k AS (SELECT *, w * CASE WHEN b = 0 THEN 1 ELSE {' + '.join(f'(h >= {c})::INT' for c in resample.CUTS)} END AS wk FROM s),"
    + """ g AS (SELECT challenger, b, floor(sum(wk * v) / sum(wk)) AS x FROM k WHERE wk > 0 GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY challenger ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY challenger) AS c FROM g WHERE b > 0),
 q AS (SELECT challenger, max(x) FILTER (WHERE i = floor(0.05 * c)) / 1000000 AS low, max(x) FILTER (WHERE i = floor(0.95 * c)) / 1000000 AS high FROM o GROUP BY 1), p AS (SELECT challenger, floor(sum(w * v) / sum(w)) / 1000000 AS gain, floor(sum(w * r) / sum(w)) / 1000000 AS recall FROM d GROUP BY 1),
 y AS (SELECT challenger, min(z) AS worst_stratum FROM (SELECT challenger, stratum, floor(sum(v) / count(*)) / 1000000 AS z, count(*) AS n FROM d GROUP BY 1, 2) WHERE n >= 10 GROUP BY 1), j AS (SELECT * FROM p JOIN q USING (challenger) LEFT JOIN y USING (challenger)),
 l AS (SELECT *, gain >= 0.01 AND low > 0 AS gain_ok, recall >= -0.005 AS recall_ok, coalesce(worst_stratum >= -0.05, TRUE) AS strata_ok FROM j) SELECT *, gain_ok AND recall_ok AND strata_ok AS accepted FROM l""",
    "lots relations items",
)
def challenger_acceptance(spark, sf_dir):
    """Rankings by other history against the one by earlier awards: weighted
    gain with its interval, guards of recall and strata, the verdict; over all targets."""
    targets, measured = _measured(spark, sf_dir, {"won": "is_winner"} | CHALLENGERS)
    # every target is measured, so each stands for itself
    weights = targets.select("query", "stratum", F.lit(1.0).alias("weight"))
    old = measured["won"].select("query", F.col("ndcg").alias("_ndcg"), F.col("winner_recall").alias("_recall")).join(weights, "query")
    new = [measured[n].withColumn("challenger", F.lit(n)) for n in CHALLENGERS]
    both = new[0].unionByName(new[1]).join(old, "query")
    differences = both.select("challenger", "query", "stratum", "weight", (F.col("ndcg") - F.col("_ndcg")).alias("ndcg"), (F.col("winner_recall") - F.col("_recall")).alias("winner_recall"))
    return resample.accepted(differences, resamples=RESAMPLES)
