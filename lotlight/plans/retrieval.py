"""Search queries: every lot whose key is divisible by 50 asks with its items,
its customer and its subject; all earlier lots answer.  Free texts are those of
every fiftieth part."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import diagnosis, search, vectors
from ..session import table, written
from ..sources import canonical
from ..sources.canonical import History
from .registry import query

AS_OF = date(2000, 1, 1)
#: All nine components weigh, and redundant texts count half.
CONFIG = search.Config(evidence_quality=0.05, item_coverage=0.10, redundant_factor=0.5)

#: Twin: visible goods, tokens, weights; then what asks (a: query, no, text, code).
_BASE = """his AS MATERIALIZED (SELECT * FROM goods WHERE publish_date < DATE '2000-01-01'), nn AS (SELECT count(*) AS docs, ln(count(*) + 1) + 1 AS top FROM his),
 tk AS MATERIALIZED (SELECT DISTINCT text, unnest(string_split(text, ' ')) AS token FROM (SELECT DISTINCT text FROM products)), df AS (SELECT token, count(*) AS df FROM his JOIN tk USING (text) GROUP BY 1),
 w AS MATERIALIZED (SELECT token, coalesce(df, 0) AS df, ln((docs + 1) / (coalesce(df, 0) + 1)) + 1 AS idf, coalesce(df, 0) <= 0.02 * docs AS rare, regexp_matches(token, '[0-9]') AND regexp_matches(token, '[a-z]') AND length(token) >= 5 AS technical, top FROM (SELECT DISTINCT token FROM tk) LEFT JOIN df USING (token), nn),
 total AS MATERIALIZED (SELECT text, sum(idf) + sum(CASE WHEN technical THEN top ELSE 0 END) AS total, count(*) FILTER (technical) AS technical, count(*) AS n FROM tk JOIN w USING (token) GROUP BY 1)"""
_LOT_ITEMS = """, one AS (SELECT lot_id, g.text, code, min(line) AS line, round(any_value(total) + CASE WHEN code IS NULL THEN 0 ELSE 1 END, 6) AS info FROM goods g JOIN total USING (text) WHERE lot_id % 50 = 0 GROUP BY 1, 2, 3),
 lv AS (SELECT DISTINCT code, code_class, code_group, code_kind FROM products WHERE code IS NOT NULL),
 best8 AS (SELECT *, row_number() OVER (PARTITION BY lot_id ORDER BY info DESC, line, text, code NULLS FIRST) AS nth FROM one),
 a AS MATERIALIZED (SELECT lot_id AS query, CAST(row_number() OVER (PARTITION BY lot_id ORDER BY line, text, code NULLS FIRST) AS INTEGER) AS no, text, b.code, code_class, code_group, code_kind FROM best8 b LEFT JOIN lv USING (code) WHERE nth <= 8)"""
_PART_ITEMS = """, lv AS (SELECT DISTINCT code, code_class, code_group, code_kind FROM products WHERE code IS NOT NULL), a AS MATERIALIZED (SELECT part AS query, 1 AS no, text, code, code_class, code_group, code_kind FROM products WHERE part % 50 = 0)"""
_FOUND = """, qt AS (SELECT DISTINCT text FROM a), few AS (SELECT qt.text AS q, token, rare, bool_or(rare) OVER (PARTITION BY qt.text) AS any_rare, count(*) OVER (PARTITION BY qt.text) AS n, row_number() OVER (PARTITION BY qt.text ORDER BY rare DESC, idf DESC, token) AS nth FROM qt JOIN tk USING (text) JOIN w USING (token)),
 met AS (SELECT DISTINCT q, text FROM few JOIN tk USING (token) WHERE rare AND nth <= 6 UNION ALL SELECT q, text FROM few JOIN tk USING (token) WHERE NOT any_rare GROUP BY q, text HAVING count(*) = any_value(n)),
 common AS (SELECT x.text AS q, y.text, sum(idf) AS got FROM tk x JOIN tk y USING (token) JOIN w USING (token) WHERE x.text IN (SELECT text FROM qt) GROUP BY 1, 2),
 inside AS MATERIALIZED (SELECT x.text AS q, token, t.text FROM (SELECT text, token FROM tk JOIN w USING (token) WHERE technical AND text IN (SELECT text FROM qt)) x JOIN (SELECT DISTINCT text FROM products) t ON t.text LIKE '%' || replace(replace(replace(token, '!', '!!'), '%', '!%'), '_', '!_') || '%' ESCAPE '!'),
 sim AS MATERIALIZED (SELECT q, text, round((coalesce(got, 0) + coalesce(n, 0) * (SELECT top FROM nn)) / total, 9) AS s FROM common FULL JOIN (SELECT q, text, count(*) AS n FROM inside GROUP BY 1, 2) USING (q, text) JOIN (SELECT text AS q, total FROM total) USING (q)),
 texthits AS MATERIALIZED (SELECT q, lot_id, part, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, lot_id, part) AS place FROM met JOIN sim USING (q, text) JOIN his USING (text) QUALIFY place <= 300),
 techhits AS (SELECT DISTINCT q, lot_id, part FROM (SELECT q, token, lot_id, part, row_number() OVER (PARTITION BY q, token ORDER BY publish_date DESC, lot_id, part) AS place FROM inside JOIN his USING (text)) WHERE place <= 100),
 qc AS (SELECT DISTINCT code, code_class, code_group, code_kind FROM a WHERE code IS NOT NULL),
 lotcode AS (SELECT qc.code AS q, lot_id, publish_date, h.code = qc.code AS exact, min_by(part, (line, part)) AS part FROM qc JOIN his h ON CASE WHEN qc.code_kind IS NOT NULL THEN h.code_kind = qc.code_kind ELSE h.code_group = qc.code_group END OR h.code = qc.code GROUP BY 1, 2, 3, 4),
 codehits AS MATERIALIZED (SELECT q, lot_id, part, exact, row_number() OVER (PARTITION BY q, exact ORDER BY publish_date DESC, lot_id) AS place FROM lotcode QUALIFY place <= CASE WHEN exact THEN 300 ELSE 200 END),
 found AS MATERIALIZED (SELECT query, lot_id, part, max(b) AS by_text FROM (SELECT query, lot_id, part, true AS b FROM a JOIN texthits ON q = text UNION ALL SELECT query, lot_id, part, true FROM a JOIN techhits ON q = text UNION ALL SELECT query, lot_id, part, false FROM a JOIN codehits ON q = code) GROUP BY 1, 2, 3)"""
_LOTS = (
    _BASE + _LOT_ITEMS + _FOUND + """, cc AS (SELECT a.code AS qc, l.code AS hc, CASE WHEN a.code = l.code THEN 1.0 WHEN NOT regexp_matches(a.code, '\\..*\\..*\\.') AND coalesce(l.code_kind = a.code_kind, CASE WHEN a.code_kind IS NULL THEN l.code_group = a.code_group END, false) THEN 0.8
  WHEN NOT regexp_matches(l.code, '\\..*\\..*\\.') AND coalesce(l.code_kind = a.code_kind, CASE WHEN l.code_kind IS NULL THEN l.code_group = a.code_group END, false) THEN 0.8 WHEN l.code_kind = a.code_kind THEN 0.7 WHEN l.code_group = a.code_group THEN 0.4 WHEN l.code_class = a.code_class THEN 0.1 ELSE 0.0 END AS c FROM qc a, lv l),
 cell AS (SELECT f.query, f.lot_id, h.publish_date, no, coalesce(s, 0) AS s, CASE WHEN a.code IS NOT NULL THEN CAST(coalesce(c, 0) AS DOUBLE) END AS c, f.part, h.text, h.code FROM found f JOIN his h USING (lot_id, part) JOIN a ON a.query = f.query LEFT JOIN sim ON sim.q = a.text AND sim.text = h.text LEFT JOIN cc ON cc.qc = a.code AND cc.hc = h.code),
 matrix AS MATERIALIZED (SELECT query, lot_id, publish_date, no, max(s) AS s, max(c) AS c, max((s, part, text, code)) AS best FROM cell GROUP BY 1, 2, 3, 4),
 subject AS (SELECT lot_id, min_by(text, (line, part)) AS subject FROM goods GROUP BY 1), whom AS (SELECT lot_id, CASE WHEN customer % 10 <> 0 THEN customer END AS customer FROM lots),
 st AS (SELECT x.lot_id AS query, y.lot_id, sum(idf) AS got FROM subject x JOIN tk u ON u.text = x.subject JOIN w USING (token) JOIN tk v ON v.token = u.token JOIN subject y ON y.subject = v.text WHERE x.lot_id % 50 = 0 GROUP BY 1, 2),
 subjtotal AS (SELECT lot_id AS query, sum(idf) AS total FROM subject JOIN tk ON tk.text = subject JOIN w USING (token) GROUP BY 1),
 lots2 AS (SELECT query, lot_id, publish_date, CAST(CAST(sum(CAST(round(s * 1e9) AS BIGINT)) AS BIGINT) // count(s) AS DOUBLE) / 1e9 AS text, CASE WHEN count(c) > 0 THEN CAST(CAST(sum(CAST(round(c * 1e9) AS BIGINT)) AS BIGINT) // count(c) AS DOUBLE) / 1e9 END AS okpd2, max_by(best, (best[1], -no)) AS best, map_from_entries(list((no, round((CAST(0.6 AS DOUBLE) * s + CASE WHEN c IS NULL THEN 0 ELSE CAST(0.3 AS DOUBLE) * c END) / (CAST(0.6 AS DOUBLE) + CASE WHEN c IS NULL THEN 0 ELSE CAST(0.3 AS DOUBLE) END), 9)) ORDER BY no)) AS match FROM matrix GROUP BY 1, 2, 3),
 scored AS MATERIALIZED (SELECT query, lot_id, publish_date, text, coalesce(okpd2, 0) AS okpd2, round(coalesce(got, 0) / total, 9) AS subject, (CAST(0.6 AS DOUBLE) * text + coalesce(CAST(0.3 AS DOUBLE) * okpd2, 0) + CAST(0.1 AS DOUBLE) * round(coalesce(got, 0) / total, 9)) / (CAST(0.6 AS DOUBLE) + CASE WHEN okpd2 IS NULL THEN 0 ELSE CAST(0.3 AS DOUBLE) END + CAST(0.1 AS DOUBLE)) AS relevance, best[2] AS part, best[3] AS product, best[4] AS code, match
  FROM lots2 JOIN subjtotal USING (query) LEFT JOIN st USING (query, lot_id))"""
)
_RANKED = (
    _LOTS + """, top300 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY relevance DESC, publish_date DESC, lot_id) AS lot_place FROM scored QUALIFY lot_place <= 300),
 e AS MATERIALIZED (SELECT t.query, r.supplier_id, t.lot_id, t.publish_date, text, okpd2, relevance, CAST(round(relevance * 1e9) AS BIGINT) AS nano, is_winner, r.platform, date_diff('day', t.publish_date, DATE '2000-01-01') AS age, product, code, match, row_number() OVER (PARTITION BY t.query, r.supplier_id ORDER BY relevance DESC, t.publish_date DESC, t.lot_id) AS nth FROM top300 t JOIN relations r ON r.lot_id = t.lot_id WHERE relevance >= 0.05),
 cover AS (SELECT query, supplier_id, sum(v) AS cover FROM (SELECT query, supplier_id, kv.key AS no, CAST(round(max(kv.value) * 1e9) AS BIGINT) / 1e9 AS v FROM (SELECT query, supplier_id, unnest(map_entries(match)) AS kv FROM e) GROUP BY 1, 2, 3) GROUP BY 1, 2),
 red AS (SELECT query, min(CASE WHEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) >= 0.8 THEN 1 ELSE 0 END) = 1 AS redundant, count(*) AS n_items, max(CASE WHEN code IS NULL THEN 0 ELSE 1 END) AS has_code FROM (SELECT query, code, list_distinct(string_split(replace(text, '-', ' '), ' ')) AS x, list_distinct(string_split(replace(subject, '-', ' '), ' ')) AS y FROM a JOIN subject ON subject.lot_id = query) GROUP BY 1),
 same AS (SELECT DISTINCT x.lot_id AS query, r.supplier_id FROM whom x JOIN whom y ON x.customer = y.customer JOIN relations r ON r.lot_id = y.lot_id WHERE x.lot_id % 50 = 0 AND r.publish_date < DATE '2000-01-01'),
 s AS (SELECT query, supplier_id, count(*) AS relevant_lots, count(*) FILTER (is_winner) AS awards, count(*) FILTER (platform = 'EM') AS em_participations, count(*) FILTER (is_winner AND platform = 'AIS_GZ') AS ais_awards, max(text) AS product_text, max(okpd2) AS okpd2, CAST(sum(nano) AS DOUBLE) / 1e9 AS al, CAST(coalesce(sum(nano) FILTER (is_winner), 0) AS DOUBLE) / 1e9 AS won, CAST(coalesce(sum(nano) FILTER (platform = 'EM'), 0) AS DOUBLE) / 1e9 AS em, min(age) AS age,
  CAST(sum(nano) FILTER (nth <= 3) AS DOUBLE) / 1e9 / 3 AS evidence_quality, list(lot_id ORDER BY nth) FILTER (nth <= 5) AS evidence_lots, list(product ORDER BY nth) FILTER (nth <= 5) AS five, min_by(coalesce(code, ''), nth) AS best_code FROM e GROUP BY 1, 2),
 f AS (SELECT s.*, n_items, redundant, has_code, customer IS NOT NULL AS has_customer, 1 - exp(-al / 10) AS historical_relevance, 1 - exp(-won / 6) AS relevant_awards, 1 - exp(-em / 6) AS em_participation, pow(0.5, age / 365.0) AS recency, CAST(CASE WHEN same.supplier_id IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS same_customer, cover / n_items AS item_coverage,
  CASE WHEN redundant THEN 0.35 * 0.5 ELSE 0.35 END AS w1, 0.30 * has_code AS w2, CASE WHEN customer IS NULL THEN 0 ELSE 0.05 END AS w7, CASE WHEN n_items >= 2 THEN 0.10 ELSE 0 END AS w9 FROM s JOIN red USING (query) JOIN whom ON whom.lot_id = s.query JOIN cover USING (query, supplier_id) LEFT JOIN same ON same.query = s.query AND same.supplier_id = s.supplier_id),
 g AS (SELECT *, round((CAST(w1 AS DOUBLE) * product_text + CAST(w2 AS DOUBLE) * okpd2 + 0.10 * historical_relevance + 0.10 * relevant_awards + 0.05 * em_participation + 0.05 * recency + CAST(w7 AS DOUBLE) * same_customer + 0.05 * evidence_quality + CAST(w9 AS DOUBLE) * item_coverage) / CAST(w1 + w2 + 0.10 + 0.10 + 0.05 + 0.05 + w7 + 0.05 + w9 AS DOUBLE), 6) AS score FROM f),
 h AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, round(relevant_awards, 4) DESC, supplier_id) AS INTEGER) AS rank FROM g)"""
)
_VIEWS = "lots relations products goods"


def _history(spark, sf_dir):
    return History(spark, sf_dir, AS_OF)


def _catalogue(spark, sf_dir):
    return search.Catalogue.of(_history(spark, sf_dir).product_items())


def _lot_queries(spark, sf_dir, catalogue):
    """Lots that ask (query, as_of, customer, subject) and their items (query,
    no, text, code), written once for all that read them; customers whose key
    ends in 0 stay unnamed."""
    own = canonical.product_items(spark, sf_dir).filter("lot_id % 50 = 0")
    named = own.select("lot_id", "line", F.col("text").alias("name"), F.col("code.code").alias("code"))
    kept = search.query_items(named, catalogue.frequency, catalogue.documents, CONFIG.max_items, CONFIG.min_technical)
    levels = canonical.products(spark, sf_dir).select(F.col("code.code").alias("_c"), F.col("code").alias("levels")).distinct()
    items = kept.join(levels, kept["code"] == levels["_c"], "left").select(F.col("lot_id").alias("query"), F.col("place").alias("no"), F.col("name").alias("text"), F.col("levels").alias("code"))
    customer = F.when(F.col("customer") % 10 != 0, F.col("customer")).alias("customer")
    lots = canonical.lots(spark, sf_dir).select("lot_id", customer).join(canonical.subjects(own), "lot_id")
    return written(lots.select(F.col("lot_id").alias("query"), F.lit(AS_OF).alias("as_of"), "customer", "subject")), written(items)


def _later(spark, sf_dir):
    return canonical.lots(spark, sf_dir).filter(F.col("publish_date") >= F.lit(AS_OF))


def _part_queries(spark, sf_dir):
    parts = canonical.products(spark, sf_dir).filter("part % 50 = 0")
    return parts.select(F.col("part").alias("query"), F.lit(1).alias("no"), "text", "code")


def _distinct_texts(spark, sf_dir):
    catalogue = _catalogue(spark, sf_dir)
    asked = catalogue.features(_part_queries(spark, sf_dir), "text", CONFIG).withColumnRenamed("text", "key")
    return catalogue, asked


@query("SELECT token, count(*) AS df, ln(((SELECT count(*) FROM part) + 1) / (count(*) + 1)) + 1 AS idf FROM tokens GROUP BY 1", "tokens")
def token_weights(spark, sf_dir):
    """Document frequency and weight of every token of the catalogue."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_name")
    df = search.document_frequency(search.tokens(parts, "part", "p_name"))
    return df.select("token", "df", scalars.idf(F.lit(parts.count()), F.col("df")).alias("idf"))


@query(
    """WITH w AS (SELECT unnest(list_distinct(string_split_regex(lower(text), '[^a-z]+'))) AS token FROM documents) SELECT token, count(*) AS df FROM w WHERE length(token) >= 3 GROUP BY 1"""
)
def corpus_token_frequency(spark, sf_dir):
    """Document frequency of ASCII words over whole texts."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    words = F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))
    return docs.select(F.explode(words).alias("token")).filter(F.length("token") >= 3).groupBy("token").agg(F.count("*").alias("df"))


@query("WITH " + _BASE + ", qt AS (SELECT DISTINCT text FROM products WHERE part % 50 = 0), x AS (SELECT text, token, df, rare, bool_or(rare) OVER (PARTITION BY text) AS any_rare, row_number() OVER (PARTITION BY text ORDER BY rare DESC, idf DESC, token) AS place FROM qt JOIN tk USING (text) JOIN w USING (token)) SELECT text, token, df, any_rare AS rare FROM x WHERE (rare AND place <= 6) OR NOT any_rare", _VIEWS)
def rare_query_tokens(spark, sf_dir):
    """What each text is searched by: its rarest tokens, or all where none is rare."""
    catalogue = _catalogue(spark, sf_dir)
    texts = _part_queries(spark, sf_dir).select("text").distinct()
    weighted = search.with_idf(search.tokens(texts, "text", "text"), catalogue.frequency, catalogue.documents)
    return search.rare_tokens(weighted, "text", catalogue.documents)


@query("WITH " + _BASE + _PART_ITEMS + _FOUND + " SELECT q AS text, lot_id, part, s AS score, CAST(place AS INTEGER) AS place FROM texthits", _VIEWS)
def text_retrieval(spark, sf_dir):
    """The text branch: 300 items at most for each text, by any rare or by all tokens."""
    catalogue, asked = _distinct_texts(spark, sf_dir)
    return search.text_hits(asked, catalogue, CONFIG).withColumnRenamed("key", "text")


@query("WITH " + _BASE + _PART_ITEMS + _FOUND + " SELECT q AS text, lot_id, part FROM techhits", _VIEWS)
def technical_retrieval(spark, sf_dir):
    """The technical branch: the newest 100 items that contain a technical token anywhere."""
    catalogue, asked = _distinct_texts(spark, sf_dir)
    return search.technical_hits(asked, catalogue, CONFIG).withColumnRenamed("key", "text")


@query(
    r"""WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL), t AS (SELECT DISTINCT unnest(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: regexp_matches(x, '[0-9%_@#*&]') AND length(x) >= 3)) AS token FROM documents WHERE doc_id % 50 = 0)
 SELECT token, count(DISTINCT doc_id) AS documents FROM t JOIN d ON d.text LIKE '%' || replace(replace(replace(token, '!', '!!'), '%', '!%'), '_', '!_') || '%' ESCAPE '!' GROUP BY 1"""
)
def substring_search(spark, sf_dir):
    """In how many documents each odd token (with a digit or a sign, wildcards of
    LIKE among them) of every fiftieth document occurs, as plain characters."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x.rlike("[0-9%_@#*&]") & (F.length(x) >= 3))
    asked = docs.filter("doc_id % 50 = 0").select(F.explode(words).alias("token")).distinct()
    return search.documents_with(asked, docs, "doc_id", r"[\x20\x09-\x0D]").groupBy("token").agg(F.count("*").alias("documents"))


@query("WITH " + _BASE + _PART_ITEMS + _FOUND + " SELECT q AS code, lot_id, part, exact, CAST(place AS INTEGER) AS place FROM codehits", _VIEWS)
def category_retrieval(spark, sf_dir):
    """The category branch: newest lots of each code and of its most specific level."""
    codes = _part_queries(spark, sf_dir).filter("code.code is not null").select(F.col("code").alias("qcode")).distinct()
    return search.category_hits(codes, _catalogue(spark, sf_dir), CONFIG).withColumnRenamed("q", "code")


def _lots(spark, sf_dir, later=False, limit=None):
    """With ``later``, only lots from the as-of date on ask: they can't find
    themselves.  With ``limit``, lots beyond a query's first may be left out."""
    catalogue = _catalogue(spark, sf_dir)
    queries, items = _lot_queries(spark, sf_dir, catalogue)
    if later:
        asks = _later(spark, sf_dir).select(F.col("lot_id").alias("query"))
        queries, items = queries.join(asks, "query", "left_semi"), written(items.join(asks, "query", "left_semi"))
    matrix = search.match_matrix(items, catalogue, CONFIG, queries, canonical.subjects(catalogue.items), limit)
    return queries, items, search.lot_scores(matrix, CONFIG)


@query("WITH " + _LOTS + " SELECT query, lot_id, no, s AS text, c AS okpd2 FROM matrix", _VIEWS)
def match_cells(spark, sf_dir):
    """The sparse matrix of retrieved lots and query items."""
    catalogue = _catalogue(spark, sf_dir)
    _, items = _lot_queries(spark, sf_dir, catalogue)
    matrix = search.match_matrix(items, catalogue, CONFIG)
    cells = matrix.select("query", "lot_id", F.posexplode(F.arrays_zip("text", "okpd2")).alias("no", "cell"))
    return cells.select("query", "lot_id", (F.col("no") + 1).alias("no"), "cell.text", "cell.okpd2")


@query("WITH " + _LOTS + " SELECT query, lot_id, publish_date, text, okpd2, subject, relevance, part FROM scored", _VIEWS)
def lot_relevance(spark, sf_dir):
    """Fused relevance of every retrieved lot."""
    return _lots(spark, sf_dir)[2].drop("match")


def _ranked(spark, sf_dir, limit=20, later=False):
    h = _history(spark, sf_dir)
    queries, items, lots = _lots(spark, sf_dir, later, CONFIG.lot_limit)
    earlier = h.lots().select("lot_id", "customer").filter("customer % 10 != 0")
    same = queries.select("query", "customer").join(earlier, "customer").join(h.relations().select("lot_id", "supplier_id"), "lot_id")
    return search.placed(search.rank_suppliers(lots, h.relations(), search.query_features(queries, items, CONFIG), same, CONFIG), limit)


@query(
    "WITH " + _RANKED + " SELECT query, supplier_id, relevant_lots, awards, em_participations, ais_awards, age, " + ", ".join(f"round({c}, 6) AS {c}" for c in search.COMPONENTS) + ", score, rank FROM h WHERE rank <= 20",
    _VIEWS,
)
def supplier_search(spark, sf_dir):
    """The 20 best suppliers for each query, with their nine components."""
    facts = ["query", "supplier_id", "relevant_lots", "awards", "em_participations", "ais_awards", "age"]
    return _ranked(spark, sf_dir).select(*facts, *[F.round(c, 6).alias(c) for c in search.COMPONENTS], "score", "rank")


@query(
    "WITH " + _RANKED + """, p AS (SELECT query, supplier_id, x.i AS i, x.p AS p FROM (SELECT query, supplier_id, unnest(list_transform(five, lambda p, i: {'i': i, 'p': p})) AS x FROM h WHERE rank <= 20) WHERE x.p IS NOT NULL),
 three AS (SELECT query, supplier_id, string_agg(p, '; ' ORDER BY i) FILTER (nth <= 3) AS products FROM (SELECT *, row_number() OVER (PARTITION BY query, supplier_id ORDER BY i) AS nth FROM (SELECT query, supplier_id, p, min(i) AS i FROM p GROUP BY 1, 2, 3)) GROUP BY 1, 2)
 SELECT query, supplier_id, rank, array_to_string(evidence_lots, '; ') AS lots, coalesce(products, '') AS products, best_code FROM h LEFT JOIN three USING (query, supplier_id) WHERE rank <= 20""",
    _VIEWS,
)
def supplier_evidence(spark, sf_dir):
    """The five most relevant lots of each ranked supplier and their first three products."""
    out = search.with_evidence(_ranked(spark, sf_dir), canonical.products(spark, sf_dir))
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), "; ")
    return out.select("query", "supplier_id", "rank", join("evidence_lots").alias("lots"), join("best_products").alias("products"), F.coalesce("best_code", F.lit("")).alias("best_code"))


@query(
    "WITH " + _RANKED + """ SELECT query, supplier_id, rank, 'matched ' || relevant_lots || ' historically similar lot(s)' || CASE WHEN okpd2 >= 1.0 THEN '; exact category match' WHEN okpd2 > 0 THEN '; related category match' ELSE '' END
 || '; ' || awards || ' relevant award(s)' || CASE WHEN same_customer > 0 THEN '; earlier history with the same customer' ELSE '' END AS reasons FROM h WHERE rank <= 20""",
    _VIEWS,
)
def supplier_reasons(spark, sf_dir):
    out = _ranked(spark, sf_dir)
    return out.select("query", "supplier_id", "rank", search.explain(out).alias("reasons"))


@query("WITH " + _RANKED + " SELECT query, h.supplier_id, n_name AS nation, rank FROM h JOIN supplier ON s_suppkey = h.supplier_id JOIN nation ON n_nationkey = s_nationkey WHERE rank <= 20 AND n_regionkey = 1", _VIEWS)
def supplier_search_region(spark, sf_dir):
    """A region filter after ranking: ranks keep their global value."""
    places = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation").filter("n_regionkey = 1"), F.col("s_nationkey") == F.col("n_nationkey"))
    return _ranked(spark, sf_dir).join(places.select(F.col("s_suppkey").alias("supplier_id"), F.col("n_name").alias("nation")), "supplier_id").select("query", "supplier_id", "nation", "rank")


_WEIGHTED = dict(zip(search.COMPONENTS, "w1 w2 0.10 0.10 0.05 0.05 w7 0.05 w9".split()))
_DIAGNOSED = (
    _RANKED + """, win AS (SELECT DISTINCT lot_id AS query, supplier_id FROM relations WHERE is_winner AND publish_date >= DATE '2000-01-01' AND lot_id % 50 = 0),
 b AS (SELECT h.* FROM h JOIN win USING (query, supplier_id) QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank) = 1),
 """ + "u AS (SELECT query, supplier_id, rank, relevant_lots, awards, em_participations, age, unnest([" + ", ".join(f"{{'name': '{c}', 'v': round({c} * 1e9), 'p': CAST({w} AS DOUBLE) * {c} / CAST(w1 + w2 + 0.10 + 0.10 + 0.05 + 0.05 + w7 + 0.05 + w9 AS DOUBLE)}}" for c, w in _WEIGHTED.items())
    + """]) AS x FROM h WHERE query IN (SELECT query FROM b WHERE rank > 10)), d AS (SELECT a.query, a.x.name AS component, round(CAST(sum(CAST(round(greatest(a.x.p - w.x.p, 0) * 1e9) AS BIGINT)) AS DOUBLE) / count(*) / 1e9, 6) AS deficit, round(count(*) FILTER (a.x.v > w.x.v) / count(*), 6) AS higher
  FROM u a JOIN u w ON w.query = a.query AND w.x.name = a.x.name JOIN b ON b.query = w.query AND b.supplier_id = w.supplier_id WHERE a.rank < b.rank GROUP BY 1, 2),
 main AS (SELECT query, max_by(component, (deficit, component)) AS cause FROM d GROUP BY 1), best AS (SELECT h.query, round(avg(h.relevant_lots), 6) AS top_lots, round(avg(h.awards), 6) AS top_awards, round(avg(h.em_participations), 6) AS top_em, round(avg(h.age), 6) AS top_age FROM h JOIN main USING (query) WHERE rank <= 10 GROUP BY 1)"""
)


def _diagnosed(spark, sf_dir):
    """Lots from the as-of date on, whose real winners are known and not visible."""
    winners = canonical.relations(spark, sf_dir).filter("is_winner and lot_id % 50 = 0").join(_later(spark, sf_dir).select("lot_id"), "lot_id", "left_semi").select(F.col("lot_id").alias("query"), "supplier_id")
    return diagnosis.diagnose(written(_ranked(spark, sf_dir, None, True).drop("evidence", "ais_awards", "score")), winners, CONFIG)


@query(
    "WITH " + _DIAGNOSED + """ SELECT q.query, CASE WHEN b.rank IS NULL THEN 'RETRIEVAL_FAILURE' WHEN b.rank > 10 THEN 'RANKING_FAILURE' ELSE 'FOUND' END AS outcome, b.supplier_id AS winner, b.rank, cause, redundant, n_items > 1 AS several_items, same_customer > 0 AS known_customer, relevant_lots = 1 AS single_lot,
 CASE WHEN cause IS NOT NULL THEN relevant_lots END AS lots, top_lots, CASE WHEN cause IS NOT NULL THEN awards END AS awards, top_awards, CASE WHEN cause IS NOT NULL THEN em_participations END AS em, top_em, CASE WHEN cause IS NOT NULL THEN age END AS age, top_age
 FROM (SELECT DISTINCT query FROM win) q LEFT JOIN b USING (query) LEFT JOIN main ON main.query = q.query LEFT JOIN best ON best.query = q.query""",
    _VIEWS,
)
def ranking_failures(spark, sf_dir):
    """What became of the real winners of later lots, the dominant cause of
    each ranking failure, and the winner's evidence beside that of the first ten."""
    names = {"relevant_lots": "lots", "awards": "awards", "em_participations": "em", "age": "age"}
    shape = [x for k, n in names.items() for x in (F.col(f"shape.{k}.winner").cast("long").alias(n), F.col(f"shape.{k}.top").alias(f"top_{n}"))]
    return _diagnosed(spark, sf_dir).select("query", "outcome", "winner", "rank", "cause", "redundant", "several_items", "known_customer", "single_lot", *shape)


@query(
    "WITH " + _DIAGNOSED + " SELECT component, count(*) FILTER (component = cause) AS dominant, round(CAST(sum(CAST(round(deficit * 1e9) AS BIGINT)) AS DOUBLE) / count(*) / 1e9, 4) AS deficit, round(CAST(sum(CAST(round(higher * 1e9) AS BIGINT)) AS DOUBLE) / count(*) / 1e9, 3) AS higher FROM d JOIN main USING (query) GROUP BY 1",
    _VIEWS,
)
def failure_causes(spark, sf_dir):
    """What each component of the score contributes to ranking failures."""
    return diagnosis.causes(_diagnosed(spark, sf_dir))


_SUGGESTED = (
    _BASE + _PART_ITEMS + _FOUND + """, x AS (SELECT query, h.code, sum(CAST(round(s * 1e9) AS BIGINT)) AS w, count(*) AS items, count(DISTINCT h.lot_id) AS lots FROM found f JOIN his h USING (lot_id, part) JOIN a USING (query) JOIN sim ON sim.q = a.text AND sim.text = h.text WHERE by_text AND h.code IS NOT NULL AND s >= 0.5 GROUP BY 1, 2),
 y AS (SELECT *, CAST(w AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY query) AS DOUBLE) AS share, CAST(sum(items) OVER (PARTITION BY query) AS BIGINT) AS support, CAST(row_number() OVER (PARTITION BY query ORDER BY w DESC, code) AS INTEGER) AS place FROM x QUALIFY place <= 3)"""
)


def _suggested(spark, sf_dir):
    return search.suggest(_part_queries(spark, sf_dir), _catalogue(spark, sf_dir), config=CONFIG)


@query("WITH " + _SUGGESTED + " SELECT query, code, round(share, 4) AS share, items, lots, support, place FROM y", _VIEWS)
def suggested_codes(spark, sf_dir):
    """Category codes that a text suggests, by similarity-weighted share."""
    return _suggested(spark, sf_dir).withColumn("share", F.round("share", 4))


@query(
    "WITH " + _SUGGESTED + """, given AS (SELECT x.part AS query, CASE WHEN x.part % 150 = 0 THEN NULL WHEN x.part % 100 = 0 THEN y.code ELSE x.code END AS provided FROM products x LEFT JOIN products y ON y.part = x.part + 1 WHERE x.part % 50 = 0),
 z AS (SELECT g.query, provided, share, support, place, CASE WHEN code = provided THEN 3 WHEN contains(code, '.') AND contains(provided, '.') AND string_split(code, '.')[:2] = string_split(provided, '.')[:2] THEN 2 WHEN split_part(code, '.', 1) = split_part(provided, '.', 1) THEN 1 WHEN provided IS NOT NULL AND code IS NOT NULL THEN 0 END AS related FROM given g LEFT JOIN y ON y.query = g.query),
 b AS (SELECT query, provided, max(support) AS support, coalesce(max(CASE WHEN share >= 0.15 THEN related END), max(CASE WHEN place = 1 THEN related END)) AS best FROM z GROUP BY 1, 2)
 SELECT query, provided, best, support, CASE WHEN provided IS NULL THEN NULL WHEN coalesce(support, 0) < 3 THEN 'UNCERTAIN' WHEN best >= 2 THEN 'ALIGNED' WHEN best = 1 THEN 'UNCERTAIN' ELSE 'MISMATCH' END AS alignment FROM b""",
    _VIEWS,
)
def code_alignment(spark, sf_dir):
    """A code given with each text (its own, another part's, or none) against those that the text suggests."""
    products = canonical.products(spark, sf_dir)
    other = products.select((F.col("part") - 1).alias("query"), F.col("code.code").alias("other"))
    given = F.when(F.col("query") % 150 == 0, None).when(F.col("query") % 100 == 0, F.col("other")).otherwise(F.col("code.code"))
    asked = _part_queries(spark, sf_dir).join(other, "query", "left").select("query", given.alias("provided"))
    return search.alignment(asked.join(_suggested(spark, sf_dir), "query", "left"))


@query(
    "WITH " + _BASE + """, one AS (SELECT lot_id, g.text AS name, code, min(line) AS line, round(any_value(total) + CASE WHEN code IS NULL THEN 0 ELSE 1 END, 6) AS info FROM goods g JOIN total USING (text) GROUP BY 1, 2, 3),
 nth AS (SELECT *, row_number() OVER (PARTITION BY lot_id ORDER BY info DESC, line, name, code NULLS FIRST) AS nth FROM one)
 SELECT lot_id, name, code, line, info, CAST(row_number() OVER (PARTITION BY lot_id ORDER BY line, name, code NULLS FIRST) AS INTEGER) AS place FROM nth WHERE nth <= 8""",
    _VIEWS,
)
def query_items(spark, sf_dir):
    """Every lot as a query of its eight most informative items."""
    catalogue = _catalogue(spark, sf_dir)
    items = canonical.product_items(spark, sf_dir).select("lot_id", "line", F.col("text").alias("name"), F.col("code.code").alias("code"))
    return search.query_items(items, catalogue.frequency, catalogue.documents)


@query(
    """WITH q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0), v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 x AS (SELECT query, vec_id, list_cosine_similarity(q.e, v.e) AS cosine FROM q, v WHERE query <> vec_id), y AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(cosine, 9) DESC, vec_id) AS place FROM x)
 SELECT query, vec_id, round(cosine, 6) AS cosine, CAST(place AS INTEGER) AS place FROM y WHERE place <= 10"""
)
def nearest_vectors(spark, sf_dir):
    """The ten nearest vectors of every query vector, exactly."""
    v = table(spark, sf_dir, "embeddings")
    return vectors.nearest(v, v.filter("vec_id % 50 = 0"), 10).withColumn("cosine", F.round("cosine", 6))


#: Texts of the semantic branch, newest items of each, and its two cut-offs.
NEAR_TEXTS, NEAR_ITEMS, CUTS = 12, 5, ("1997-06-01", "2000-01-01")

_SEMANTIC = """tx AS (SELECT text, min(part) AS part, min(publish_date) AS first_seen FROM goods GROUP BY 1), em AS (SELECT text, md5(text) AS key, first_seen, CAST(embedding AS DOUBLE[]) AS e FROM tx JOIN embeddings ON vec_id = part % (SELECT count(*) FROM embeddings)),
 asked AS (SELECT part AS query, text, CAST(embedding AS DOUBLE[]) AS e FROM products JOIN embeddings ON vec_id = part % (SELECT count(*) FROM embeddings) WHERE part % 50 = 0), cuts AS (SELECT CAST(unnest(['1997-06-01', '2000-01-01']) AS DATE) AS as_of),
 nt AS (SELECT query, as_of, em.text, key, list_cosine_similarity(asked.e, em.e) AS cosine, row_number() OVER (PARTITION BY query, as_of ORDER BY round(list_cosine_similarity(asked.e, em.e), 9) DESC, key) AS rank FROM asked, cuts, em WHERE first_seen < as_of QUALIFY rank <= 12),
 ni AS (SELECT query, as_of, lot_id, part, cosine, rank, row_number() OVER (PARTITION BY query, as_of, nt.text ORDER BY publish_date DESC, lot_id, part) AS nth FROM nt JOIN goods USING (text) WHERE publish_date < as_of QUALIFY nth <= 5)"""


def _semantic(spark, sf_dir):
    """Items of the texts nearest to every fiftieth part's, at two dates; a
    part's vector is the one with its key modulo the number of vectors."""
    vectors_of = table(spark, sf_dir, "embeddings")
    n = vectors_of.count()
    embedded = lambda df: df.withColumn("vec_id", F.col("part") % n).join(vectors_of.select("vec_id", "embedding"), "vec_id")
    items = canonical.product_items(spark, sf_dir)
    texts = items.groupBy("text").agg(F.min("part").alias("part"), F.min("publish_date").alias("first_seen")).withColumn("key", F.md5("text"))
    index = vectors.AsOfIndex(embedded(texts))
    asked = embedded(_part_queries(spark, sf_dir).withColumn("part", F.col("query"))).withColumn("as_of", F.explode(F.array(*[F.lit(c).cast("date") for c in CUTS])))
    return vectors.newest_items(index.nearest(asked, NEAR_TEXTS), texts.select("key", "text"), items, NEAR_ITEMS)


@query("WITH " + _SEMANTIC + " SELECT query, as_of, lot_id, part, round(cosine, 6) AS cosine, CAST(rank AS INTEGER) AS rank FROM ni", "lots products goods")
def semantic_retrieval(spark, sf_dir):
    """The semantic branch: newest items of the nearest texts first seen before each date, with cosine and rank."""
    return _semantic(spark, sf_dir).withColumn("cosine", F.round("cosine", 6))


@query(
    "WITH " + _BASE + _PART_ITEMS + _FOUND + ", " + _SEMANTIC + """ SELECT query, n.lot_id, n.part, round(cosine, 6) AS cosine, CAST(rank AS INTEGER) AS rank, NOT bool_or(f.lot_id IS NOT NULL) AS semantic_only FROM ni n LEFT JOIN (SELECT DISTINCT query, lot_id FROM found) f USING (query, lot_id) WHERE as_of = DATE '2000-01-01' AND rank <= 6 GROUP BY ALL""",
    _VIEWS,
)
def semantic_provenance(spark, sf_dir):
    """Of the six nearest texts, which lots no other branch finds."""
    near = vectors.restricted(_semantic(spark, sf_dir).filter(F.col("as_of") == F.lit(AS_OF)), 6)
    lexical = search.retrieve(_part_queries(spark, sf_dir), _catalogue(spark, sf_dir), CONFIG).select("query", "lot_id").distinct().withColumn("_met", F.lit(True))
    out = near.join(lexical, ["query", "lot_id"], "left")
    return out.select("query", "lot_id", "part", F.round("cosine", 6).alias("cosine"), "rank", F.col("_met").isNull().alias("semantic_only"))


@query(
    """WITH p AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS t FROM part), s AS (SELECT p_partkey, string_split(p_name, ' ') AS t, list_distinct(list_append(string_split(lower(p_type), ' '), string_split(p_name, ' ')[1])) AS u FROM part)
 SELECT p_partkey, len(list_intersect(t, u)) / len(list_distinct(list_concat(t, u))) AS redundancy, len(list_intersect(t, u)) / len(list_distinct(list_concat(t, u))) >= 0.8 AS redundant FROM s"""
)
def text_redundancy(spark, sf_dir):
    """Token overlap of a part's name with a title of its type and first word."""
    own = F.split("p_name", " ")
    title = F.array_distinct(F.array_append(F.split(F.lower("p_type"), " "), own[0]))
    j = scalars.jaccard(own, title)
    return table(spark, sf_dir, "part").select("p_partkey", j.alias("redundancy"), (j >= 0.8).alias("redundant"))
