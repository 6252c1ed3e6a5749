"""Market views: categories with candidates, batches, cards, resolution."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import pool_health, resolver, search, similar
from ..session import table
from ..sources import canonical
from ..sources.canonical import History
from .analytics import _concentration
from .registry import query

LATE = date(2000, 1, 1)


@query(
    _concentration(
        "code_group", LATE, 20,
        """, seen AS (SELECT DISTINCT i.code_group AS code, o.supplier_id FROM observed o JOIN items i ON i.lot_id = o.lot_id WHERE o.publish_date < DATE '2000-01-01' AND i.publish_date < DATE '2000-01-01'),
 u AS (SELECT code, count(*) AS known FROM seen GROUP BY 1) SELECT l.code, l.label, l.hhi, coalesce(u.known, 0) AS known, (SELECT count(*) FROM supplier) - coalesce(u.known, 0) AS unseen FROM labelled l LEFT JOIN u ON u.code = l.code""",
    ),
    "lots relations observed items",
)
def market_intelligence(spark, sf_dir):
    """Concentration of each group beside its known and unseen suppliers."""
    total = table(spark, sf_dir, "supplier").count()
    known = F.col("observed_suppliers")
    return pool_health.concentration(History(spark, sf_dir, LATE), "group").select("code", "label", "hhi", known.alias("known"), (F.lit(total) - known).alias("unseen"))


@query(
    """WITH a AS (SELECT code_class, supplier_id, count(DISTINCT r.lot_id) AS n FROM relations r JOIN items i ON i.lot_id = r.lot_id WHERE is_winner GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY code_class ORDER BY n DESC, supplier_id) AS place FROM a),
 t AS (SELECT supplier_id, min(place) AS best FROM p WHERE place <= 5 GROUP BY 1) SELECT supplier_id, best FROM t WHERE supplier_id % 10 <> 3""",
    "lots relations items",
)
def batch_selection(spark, sf_dir):
    """Top winners of each class for the next batch, less a holdout."""
    won = canonical.relations(spark, sf_dir).filter("is_winner").select("lot_id", "supplier_id")
    classes = canonical.items(spark, sf_dir).select("lot_id", "code_class").distinct()
    counted = won.join(classes, "lot_id").groupBy("code_class", "supplier_id").agg(F.count("*").alias("n"))
    best = search.top(counted, "code_class", [F.desc("n"), "supplier_id"], 5).groupBy("supplier_id").agg(F.min("place").cast("long").alias("best"))
    return best.filter("supplier_id % 10 <> 3")


@query(
    """WITH r AS (SELECT lot_id, count(*) AS relations, count(*) FILTER (WHERE is_winner) AS winners FROM relations GROUP BY 1), i AS (SELECT lot_id, count(*) AS items, count(DISTINCT code) AS codes, min(name) AS first_name FROM items GROUP BY 1)
 SELECT lot_id, publish_date, platform, customer, relations, winners, items, codes, first_name, CASE WHEN items > 5 AND codes > 5 THEN 'HARD' WHEN relations > 3 THEN 'MEDIUM' ELSE 'EASY' END AS card FROM lots JOIN r USING (lot_id) JOIN i USING (lot_id)""",
    "lots relations items",
)
def golden_cards(spark, sf_dir):
    """Facts of every lot on one card."""
    rel = canonical.relations(spark, sf_dir).groupBy("lot_id").agg(F.count("*").alias("relations"), F.count_if("is_winner").alias("winners"))
    held = canonical.items(spark, sf_dir).groupBy("lot_id").agg(F.count("*").alias("items"), F.countDistinct("code").alias("codes"), F.min("name").alias("first_name"))
    card = F.when((F.col("items") > 5) & (F.col("codes") > 5), "HARD").when(F.col("relations") > 3, "MEDIUM").otherwise("EASY")
    return canonical.lots(spark, sf_dir).drop("price").join(rel, "lot_id").join(held, "lot_id").withColumn("card", card)


@query(
    """WITH r AS (SELECT lot_id, count(*) AS n FROM relations GROUP BY 1 HAVING count(*) >= 6), i AS (SELECT lot_id, count(*) AS n, bool_or(contains(name, 'small')) AS named FROM items GROUP BY 1 HAVING count(*) <= 7) SELECT lot_id, r.n AS participants, i.n AS items FROM r JOIN i USING (lot_id) WHERE NOT named""",
    "lots relations items",
)
def generic_titles(spark, sf_dir):
    """Lots with many participants, few items, and no telling name."""
    rel = canonical.relations(spark, sf_dir).groupBy("lot_id").agg(F.count("*").alias("participants")).filter("participants >= 6")
    held = canonical.items(spark, sf_dir).groupBy("lot_id").agg(F.count("*").alias("items"), F.bool_or(F.col("name").contains("small")).alias("named")).filter("items <= 7 and not named")
    return rel.join(held, "lot_id").drop("named")


@query(
    """WITH c(component, n_rows) AS (SELECT 'lots', (SELECT count(*) FROM orders) UNION ALL SELECT 'items', (SELECT count(*) FROM lineitem) UNION ALL SELECT 'suppliers', (SELECT count(*) FROM supplier) UNION ALL SELECT 'late lots', (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '2030-01-01'))
 SELECT component, n_rows, CASE WHEN n_rows > 0 THEN 'ok' WHEN component = 'late lots' THEN 'degraded' ELSE 'unavailable' END AS status FROM c"""
)
def readiness(spark, sf_dir):
    """Whether each part of the data can serve."""
    late = F.col("o_orderdate") >= F.lit("2030-01-01").cast("timestamp_ntz")
    counts = [("lots", table(spark, sf_dir, "orders")), ("items", table(spark, sf_dir, "lineitem")), ("suppliers", table(spark, sf_dir, "supplier")), ("late lots", table(spark, sf_dir, "orders").filter(late))]
    out = None
    for name, rows in counts:
        one = rows.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("component"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("status", F.when(F.col("n_rows") > 0, "ok").when(F.col("component") == "late lots", "degraded").otherwise("unavailable"))


@query(
    """WITH c AS (SELECT DISTINCT p_type AS k, CAST(NULL AS VARCHAR) AS parent FROM part UNION SELECT DISTINCT p_type || '.' || p_brand, p_type FROM part UNION SELECT DISTINCT p_type || '.' || p_brand || '.' || CAST(p_size AS VARCHAR), p_type || '.' || p_brand FROM part)
 SELECT k AS code, k AS ancestor, 0 AS distance FROM c UNION ALL SELECT k, parent, 1 FROM c WHERE parent IS NOT NULL UNION ALL SELECT a.k, b.parent, 2 FROM c a JOIN c b ON b.k = a.parent WHERE b.parent IS NOT NULL"""
)
def taxonomy_ancestors(spark, sf_dir):
    """Every code with all its ancestors."""
    code, group, klass = canonical.code_parts()
    parts = table(spark, sf_dir, "part").select(code, group, klass)
    nodes = parts.select(F.col("code_class").alias("code"), F.lit(None).cast("string").alias("parent")).unionByName(parts.select(F.col("code_group").alias("code"), F.col("code_class").alias("parent"))).unionByName(parts.select("code", F.col("code_group").alias("parent"))).distinct()
    return resolver.ancestors(nodes, 3)


@query(
    """WITH t AS (SELECT p_brand || '.' || CAST(p_size AS VARCHAR) AS code, min(p_name || ' ' || lower(p_type)) AS title FROM part GROUP BY 1), q AS (SELECT p_partkey AS query, p_name || ' ' || lower(p_type) AS text FROM part),
 x AS (SELECT query, min(code) AS exact_code, count(*) AS exact_codes FROM q JOIN t ON title = text GROUP BY 1), tt AS (SELECT DISTINCT code, unnest(string_split(title, ' ')) AS token FROM t), n AS (SELECT count(*) AS docs FROM t), d AS (SELECT token, count(*) AS df FROM tt GROUP BY 1),
 qq AS (SELECT DISTINCT query, unnest(string_split(text, ' ')) AS token FROM q), w AS (SELECT query, qq.token, ln((docs + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM qq CROSS JOIN n LEFT JOIN d ON d.token = qq.token), tot AS (SELECT query, sum(idf) AS total FROM w GROUP BY 1),
 s AS (SELECT query, code, round(sum(idf) / any_value(total), 6) AS score FROM w JOIN tt USING (token) JOIN tot USING (query) GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, code) AS place FROM s),
 b AS (SELECT query, max(CASE WHEN place = 1 THEN code END) AS term_code, max(CASE WHEN place = 1 THEN score END) AS score, coalesce(max(CASE WHEN place = 2 THEN score END), 0) AS second FROM p WHERE place <= 2 GROUP BY 1)
 SELECT q.query, coalesce(exact_code, term_code) AS code, CASE WHEN exact_codes > 0 THEN 1.0 ELSE coalesce(score, 0.0) END AS score, CASE WHEN exact_codes > 0 THEN 'exact' WHEN score IS NOT NULL THEN 'terms' ELSE 'none' END AS found_by,
 CASE WHEN exact_codes = 1 THEN 'RESOLVED' WHEN exact_codes > 1 THEN 'AMBIGUOUS' WHEN score >= 0.36 AND score - second >= 0.18 THEN 'RESOLVED' WHEN score >= 0.36 THEN 'AMBIGUOUS' ELSE 'UNCERTAIN' END AS decision FROM q LEFT JOIN x ON x.query = q.query LEFT JOIN b ON b.query = q.query"""
)
def category_resolution(spark, sf_dir):
    """All part names resolved against titles of brand and size categories."""
    parts = table(spark, sf_dir, "part")
    text = F.concat_ws(" ", "p_name", F.lower("p_type"))
    titles = parts.groupBy(F.concat_ws(".", "p_brand", F.col("p_size").cast("string")).alias("code")).agg(F.min(text).alias("title"))
    asked = parts.select(F.col("p_partkey").alias("query"), text.alias("text"))
    return resolver.resolve(asked, titles)


_WORDS = r"unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda x: length(x) >= 6)))"


@query(
    f"""WITH RECURSIVE q AS (SELECT DISTINCT doc_id AS query, {_WORDS} AS word FROM documents WHERE doc_id % 50 = 0), po AS (SELECT item_id AS code, {_WORDS} AS term FROM benchmark), v AS (SELECT DISTINCT term FROM po), u AS (SELECT DISTINCT word FROM q WHERE word NOT IN (SELECT term FROM v)),
 c AS MATERIALIZED (SELECT word, term, length(word) AS la, length(term) AS lb FROM u JOIN v ON abs(length(word) - length(term)) <= 2 AND levenshtein(word, term) <= 0.36 * (length(word) + length(term)) + 1e-9),
 runs AS MATERIALIZED (SELECT word, term, i, j, max(k) AS run FROM (SELECT *, unnest(range(1, least(la, lb) + 1)) AS k FROM (SELECT *, unnest(range(1, lb + 1)) AS j FROM (SELECT *, unnest(range(1, la + 1)) AS i FROM c))) WHERE i + k <= la + 1 AND j + k <= lb + 1 AND substr(word, i, k) = substr(term, j, k) GROUP BY 1, 2, 3, 4),
 r AS (SELECT word, term, 1 AS alo, la + 1 AS ahi, 1 AS blo, lb + 1 AS bhi, 0 AS m FROM c UNION ALL
  SELECT word, term, CASE side WHEN 1 THEN alo ELSE best[1] - best[2] END, CASE side WHEN 1 THEN -best[2] ELSE ahi END, CASE side WHEN 1 THEN blo ELSE best[1] - best[3] END, CASE side WHEN 1 THEN -best[3] ELSE bhi END, CASE side WHEN 1 THEN best[1] ELSE 0 END
  FROM (SELECT word, term, alo, ahi, blo, bhi, max((least(run, ahi - i, bhi - j), -i, -j)) AS best FROM r JOIN runs USING (word, term) WHERE i >= alo AND i < ahi AND j >= blo AND j < bhi GROUP BY 1, 2, 3, 4, 5, 6), (SELECT unnest([1, 2]) AS side)),
 near AS (SELECT word, term, 2.0 * sum(m) / (length(word) + length(term)) AS ratio FROM r GROUP BY 1, 2 HAVING 2.0 * sum(m) / (length(word) + length(term)) >= 0.88),
 best AS (SELECT query, code, max(ratio) AS ratio, min_by(term, (-ratio, term)) AS term FROM q JOIN near USING (word) JOIN po USING (term) GROUP BY 1, 2)
 SELECT query, code, CAST(round(ratio, 6) AS DOUBLE) AS ratio, term, CAST(round(least(0.4, 0.2 + 0.2 * ratio), 3) AS DOUBLE) AS confidence FROM best"""
)
def fuzzy_categories(spark, sf_dir):
    """Suggestions for words of every fiftieth document that no title (a
    benchmark item) has: titles with a term that is nearly the same."""
    words = lambda df, key, name: df.select(key, F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: F.length(x) >= 6))).alias(name))
    asked = words(table(spark, sf_dir, "documents").filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "query"), "query", "word")
    titles = words(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "code"), "code", "term")
    return similar.fuzzy_codes(asked, titles).withColumn("ratio", F.round("ratio", 6))


@query(
    """WITH p AS (SELECT o_custkey AS k, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders GROUP BY 1), s AS (SELECT least(done / n, 1.0) AS score, least(n, 20) / 40.0 AS second, done >= 3 AS correct FROM p),
 h AS (SELECT round(score, 2) AS score, round(score - second, 2) AS gap, correct, count(*) AS n FROM s GROUP BY 1, 2, 3), g AS (SELECT * FROM h CROSS JOIN (SELECT unnest([0.2, 0.4, 0.6]) AS accept) a CROSS JOIN (SELECT unnest([0.0, 0.2]) AS margin) m)
 SELECT CAST(accept AS DOUBLE) AS accept, CAST(margin AS DOUBLE) AS margin, CAST(sum(n) AS BIGINT) AS cases, CAST(coalesce(sum(n) FILTER (WHERE score >= accept AND gap >= margin), 0) AS BIGINT) AS taken, CAST(coalesce(sum(n) FILTER (WHERE score >= accept AND gap >= margin AND correct), 0) AS BIGINT) AS "right" FROM g GROUP BY 1, 2"""
)
def threshold_grid(spark, sf_dir):
    """Coverage and precision of a stated grid of decision thresholds."""
    held = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    scored = held.select(F.least(F.col("done") / F.col("n"), F.lit(1.0)).alias("score"), (F.least(F.col("n"), F.lit(20)) / 40.0).alias("second"), (F.col("done") >= 3).alias("correct"))
    return resolver.grid(scored, [0.2, 0.4, 0.6], [0.0, 0.2])
