"""Queries on category pools, reconciliation and loading."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import ingest, pool_health, reconcile
from ..session import table
from ..sources import canonical
from ..sources.canonical import History
from .registry import query

EARLY, LATE = date(1996, 1, 1), date(2000, 1, 1)
ANY = pool_health.Thresholds(min_lots=1, min_awards=1)

_TIER = """CASE WHEN lots < {n} OR awards < {n} OR top1_share IS NULL OR hhi IS NULL THEN 'INSUFFICIENT_DATA'
 WHEN top1_share >= 0.80 OR hhi >= 0.60 THEN 'VERY_HIGH' WHEN top1_share >= 0.50 OR hhi >= 0.32 THEN 'HIGH'
 WHEN top1_share >= 0.25 OR hhi >= 0.125 THEN 'MODERATE' ELSE 'LOW' END"""

_AWARDS = """scope_lots AS (SELECT DISTINCT lot_id, {scope} AS code FROM items WHERE publish_date < DATE '{as_of}'),
 per AS (SELECT code, supplier_id, count(*) FILTER (WHERE is_winner) AS awards, count(*) AS observed FROM scope_lots JOIN observed USING (lot_id) WHERE publish_date < DATE '{as_of}' GROUP BY 1, 2),
 placed AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY awards DESC, supplier_id) AS place FROM per)"""

_CONCENTRATION = (
    _AWARDS
    + """, shares AS (SELECT code, CAST(sum(awards) AS BIGINT) AS awards, count(*) FILTER (WHERE awards > 0) AS winning_suppliers, count(*) AS observed_suppliers,
 max(CASE WHEN place = 1 THEN awards END) AS top1, CAST(sum(CASE WHEN place <= 3 THEN awards END) AS BIGINT) AS top3, CAST(sum(awards * awards) AS BIGINT) AS squares FROM placed GROUP BY code),
 support AS (SELECT code, count(*) AS lots FROM scope_lots GROUP BY code),
 joined AS (SELECT code, lots, coalesce(awards, 0) AS awards, coalesce(winning_suppliers, 0) AS winning_suppliers, coalesce(observed_suppliers, 0) AS observed_suppliers,
 CASE WHEN awards > 0 THEN top1 / CAST(awards AS DOUBLE) END AS top1_share, CASE WHEN awards > 0 THEN top3 / CAST(awards AS DOUBLE) END AS top3_share,
 CASE WHEN awards > 0 THEN squares / (CAST(awards AS DOUBLE) * CAST(awards AS DOUBLE)) END AS hhi FROM support LEFT JOIN shares USING (code)),
 labelled AS (SELECT *, {tier} AS label FROM joined)"""
)


def _concentration(scope: str, as_of: date, least: int, tail: str = "SELECT * FROM labelled") -> str:
    return "WITH " + _CONCENTRATION.format(scope=scope, as_of=as_of, tier=_TIER.format(n=least)) + " " + tail


@query(_concentration("code", EARLY, 1), "lots relations observed items")
def category_concentration(spark, sf_dir):
    """Support, award shares, index and tier of every full code."""
    return pool_health.concentration(History(spark, sf_dir, EARLY), "code", ANY)


@query(_concentration("code_group", LATE, 20), "lots relations observed items")
def category_concentration_groups(spark, sf_dir):
    return pool_health.concentration(History(spark, sf_dir, LATE), "group")


@query(_concentration("code_class", LATE, 20), "lots relations observed items")
def category_concentration_classes(spark, sf_dir):
    return pool_health.concentration(History(spark, sf_dir, LATE), "class")


@query(
    "WITH "
    + _AWARDS.format(scope="code_group", as_of=LATE)
    + """, s AS (SELECT count(*) AS lots, count(DISTINCT customer) AS customers FROM lots WHERE publish_date < DATE '2000-01-01' AND lot_id IN (SELECT lot_id FROM scope_lots WHERE code = 'ECONOMY.Brand#2')),
 r AS (SELECT supplier_id, count(*) FILTER (WHERE is_winner) AS awards, count(*) FILTER (WHERE is_winner AND publish_date >= DATE '1999-01-01') AS recent, bool_or(platform = 'EM') AS em,
 bool_or(platform = 'EM' AND is_winner) AS em_won, bool_or(platform = 'AIS_GZ' AND is_winner) AS ais_won FROM observed WHERE publish_date < DATE '2000-01-01' AND lot_id IN (SELECT lot_id FROM scope_lots WHERE code = 'ECONOMY.Brand#2') GROUP BY 1),
 p AS (SELECT awards, row_number() OVER (ORDER BY awards DESC, supplier_id) AS place FROM r),
 a AS (SELECT count(*) AS observed_suppliers, count(*) FILTER (WHERE awards > 0) AS winning_suppliers, count(*) FILTER (WHERE recent > 0) AS recent_winners, count(*) FILTER (WHERE em) AS em_observed,
 count(*) FILTER (WHERE em_won) AS em_winning, count(*) FILTER (WHERE ais_won) AS ais_winning, CAST(coalesce(sum(awards), 0) AS BIGINT) AS awards FROM r),
 q AS (SELECT max(awards) AS top1, CAST(sum(awards) FILTER (WHERE place <= 3) AS BIGINT) AS top3, CAST(sum(awards * awards) AS BIGINT) AS squares FROM p),
 joined AS (SELECT s.*, a.*, top1 / CAST(awards AS DOUBLE) AS top1_share, top3 / CAST(awards AS DOUBLE) AS top3_share, squares / (CAST(awards AS DOUBLE) * CAST(awards AS DOUBLE)) AS hhi FROM s, a, q)
 SELECT *, """
    + _TIER.format(n=20)
    + " AS label FROM joined",
    "lots relations observed items",
)
def pool_health_group(spark, sf_dir):
    """One category in full."""
    return pool_health.analyze(History(spark, sf_dir, LATE), "group", "ECONOMY.Brand#2")


@query(
    _concentration(
        "code", EARLY, 1,
        """SELECT code, label, CASE WHEN label = 'INSUFFICIENT_DATA' THEN label WHEN label = 'LOW' THEN 'NO_EXPANSION_SIGNAL' WHEN label = 'MODERATE' THEN 'REVIEW_POOL' ELSE 'EXPANSION_RECOMMENDED' END AS signal,
 concat_ws('|', CASE WHEN label = 'INSUFFICIENT_DATA' THEN 'INSUFFICIENT_HISTORY' WHEN label = 'LOW' THEN 'LOW_HISTORICAL_CONCENTRATION' ELSE label || '_CONCENTRATION' END,
 CASE WHEN label IN ('HIGH', 'VERY_HIGH') AND top1_share >= 0.80 THEN 'DOMINANT_TOP_SUPPLIER' END, CASE WHEN label IN ('HIGH', 'VERY_HIGH') AND winning_suppliers <= 3 THEN 'LIMITED_WINNING_SUPPLIERS' END) AS reasons FROM labelled""",
    ),
    "lots relations observed items",
)
def expansion_signals(spark, sf_dir):
    return pool_health.expansion(pool_health.concentration(History(spark, sf_dir, EARLY), "code", ANY))


@query(
    "WITH " + _AWARDS.format(scope="code_group", as_of=LATE) + ", b AS (SELECT *, max(awards) OVER (PARTITION BY code) AS best FROM placed) SELECT code, supplier_id, awards, observed, CAST(place - 1 AS INTEGER) AS alternative FROM b WHERE place > 1 AND place <= 11 AND best > 0",
    "lots relations observed items",
)
def pool_alternatives(spark, sf_dir):
    return pool_health.alternatives(History(spark, sf_dir, LATE), "group")


@query(_concentration("code", EARLY, 1, "SELECT label, count(*) AS categories, CAST(sum(awards) AS BIGINT) AS awards, max(hhi) AS max_hhi, min(top1_share) AS min_top1, CAST(sum(winning_suppliers) AS BIGINT) AS winners FROM labelled GROUP BY label"), "lots relations observed items")
def tier_report(spark, sf_dir):
    """Categories by tier with their extremes."""
    rows = category_concentration(spark, sf_dir)
    return rows.groupBy("label").agg(F.count("*").alias("categories"), F.sum("awards").alias("awards"), F.max("hhi").alias("max_hhi"), F.min("top1_share").alias("min_top1"), F.sum("winning_suppliers").alias("winners"))


@query(_concentration("code_group", LATE, 20, "SELECT code, hhi, place FROM (SELECT code, hhi, CAST(row_number() OVER (ORDER BY hhi DESC, code) AS INTEGER) AS place FROM labelled WHERE awards >= 20) x WHERE place <= 10"), "lots relations observed items")
def most_concentrated(spark, sf_dir):
    """The ten most concentrated supported categories (a report)."""
    rows = category_concentration_groups(spark, sf_dir).filter("awards >= 20").orderBy(F.desc("hhi"), "code").limit(10)
    from pyspark.sql import Window

    return rows.select("code", "hhi", F.row_number().over(Window.orderBy(F.desc("hhi"), "code")).alias("place"))


@query(
    """WITH l AS (SELECT DISTINCT code, lot_id FROM items WHERE publish_date < DATE '1996-01-01'), a AS (SELECT code, count(*) AS awards FROM l JOIN relations USING (lot_id) WHERE is_winner AND publish_date < DATE '1996-01-01' GROUP BY code),
 n AS (SELECT code, count(*) AS lots FROM l GROUP BY code) SELECT p.code, coalesce(lots, 0) AS lots, coalesce(awards, 0) AS awards, CASE WHEN coalesce(lots, 0) = 0 THEN 'NONE' WHEN lots >= 20 AND coalesce(awards, 0) >= 20 THEN 'SUFFICIENT' ELSE 'SPARSE' END AS status
 FROM (SELECT DISTINCT p_type || '.' || p_brand || '.' || CAST(p_size AS VARCHAR) AS code FROM part) p LEFT JOIN n USING (code) LEFT JOIN a USING (code)""",
    "lots relations items",
)
def code_history(spark, sf_dir):
    """How much history supports each code of the catalogue."""
    h = History(spark, sf_dir, EARLY)
    scope = h.categories("code")
    won = scope.join(h.relations().filter("is_winner").select("lot_id", "supplier_id"), "lot_id").groupBy("code").agg(F.count("*").alias("awards"))
    held = scope.groupBy("code").agg(F.count("*").alias("lots"))
    codes = table(spark, sf_dir, "part").select(canonical.code_parts()[0]).distinct()
    out = codes.join(held, "code", "left").join(won, "code", "left").na.fill(0, ["lots", "awards"])
    return out.withColumn("status", F.when(F.col("lots") == 0, "NONE").when((F.col("lots") >= 20) & (F.col("awards") >= 20), "SUFFICIENT").otherwise("SPARSE"))


@query(
    """WITH c AS (SELECT c_custkey * 2 AS supplier_id, c_acctbal >= 0 AS valid FROM customer), t AS (SELECT DISTINCT lot_id FROM items WHERE code_group = 'ECONOMY.Brand#2' AND publish_date < DATE '2000-01-01'),
 g AS (SELECT supplier_id, min(publish_date) AS first_seen, max(publish_date) AS last_seen, count(*) AS lots, count(*) FILTER (WHERE is_winner) AS wins, count(*) FILTER (WHERE t.lot_id IS NOT NULL) AS target_lots,
 count(*) FILTER (WHERE t.lot_id IS NOT NULL AND is_winner) AS target_wins FROM observed o LEFT JOIN t ON t.lot_id = o.lot_id WHERE publish_date < DATE '2000-01-01' AND supplier_id IN (SELECT supplier_id FROM c WHERE valid) GROUP BY 1)
 SELECT supplier_id, CASE WHEN NOT valid THEN 'INVALID_INN' WHEN target_lots > 0 THEN 'CATEGORY_HISTORICAL' WHEN lots > 0 THEN 'HISTORICAL_OTHER_CATEGORY' ELSE 'EXTERNAL_NEW' END AS status, first_seen, last_seen,
 coalesce(lots, 0) AS lots, coalesce(wins, 0) AS wins, coalesce(target_lots, 0) AS target_lots, coalesce(target_wins, 0) AS target_wins FROM c LEFT JOIN g USING (supplier_id)""",
    "lots relations observed items",
)
def candidate_reconciliation(spark, sf_dir):
    """Customers as supplier candidates, some invalid, against the history."""
    given = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("supplier_id"), (F.col("c_acctbal") >= 0).alias("valid"))
    return reconcile.candidates(History(spark, sf_dir, LATE), given, "group", "ECONOMY.Brand#2")


_ORDER = ", ".join(canonical.LINE_ORDER)


@query(
    f"""WITH n AS (SELECT l_orderkey AS lot_id, l_suppkey AS supplier_id, l_returnflag = 'R' AS is_winner, CASE WHEN l_linestatus = 'O' THEN '' ELSE l_linestatus || CAST(l_linenumber AS VARCHAR) END AS kpp, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS row_no FROM lineitem)
 SELECT lot_id, supplier_id, bool_or(is_winner) AS is_winner, arg_min(kpp, CASE WHEN kpp <> '' THEN row_no END) FILTER (WHERE kpp <> '') AS kpp, string_agg(CAST(row_no AS VARCHAR), ',' ORDER BY row_no) AS row_nos FROM n GROUP BY 1, 2"""
)
def relation_merge(spark, sf_dir):
    """Repeated relations of a lot merged, with their row numbers."""
    lines = ingest.numbered(table(spark, sf_dir, "lineitem"), "l_orderkey", canonical.LINE_ORDER, "row_no")
    kpp = F.when(F.col("l_linestatus") == "O", "").otherwise(F.concat("l_linestatus", F.col("l_linenumber").cast("string")))
    rows = lines.select(F.col("l_orderkey").alias("lot_id"), F.col("l_suppkey").alias("supplier_id"), (F.col("l_returnflag") == "R").alias("is_winner"), kpp.alias("kpp"), "row_no")
    return ingest.merge_relations(rows, ["lot_id", "supplier_id"])


@query(f"SELECT l_orderkey AS lot_id, l_partkey AS part, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS INTEGER) AS line_no FROM lineitem")
def item_line_numbers(spark, sf_dir):
    lines = ingest.numbered(table(spark, sf_dir, "lineitem"), "l_orderkey", canonical.LINE_ORDER)
    return lines.select(F.col("l_orderkey").alias("lot_id"), F.col("l_partkey").alias("part"), "line_no")


@query("SELECT l_orderkey, count(*) AS n, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY 1 HAVING count(*) <> max(l_linenumber) OR min(l_linenumber) <> 1")
def line_number_gaps(spark, sf_dir):
    return ingest.line_gaps(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def lots_without_winner(spark, sf_dir):
    won = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(won, "o_orderkey", "left_anti")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, p_retailprice FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_extendedprice < p_retailprice * l_quantity * 0.1")
def price_mismatches(spark, sf_dir):
    """Items joined with their catalogue where the price differs too much."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    both = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    return both.filter(F.col("l_extendedprice") < F.col("p_retailprice") * F.col("l_quantity") * 0.1).select("l_orderkey", "l_linenumber", "l_extendedprice", "p_retailprice")


@query(
    """WITH known AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') SELECT 'loaded' AS part, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM known)
 UNION ALL SELECT 'quarantined', count(*), CAST(sum(l_linenumber) AS BIGINT) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM known)"""
)
def quarantine_split(spark, sf_dir):
    known = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") != "F").select(F.col("o_orderkey").alias("l_orderkey"))
    good, bad = ingest.split_known(table(spark, sf_dir, "lineitem"), known, "l_orderkey")
    both = good.select(F.lit("loaded").alias("part"), "l_linenumber").unionByName(bad.select(F.lit("quarantined").alias("part"), "l_linenumber"))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


@query(
    """WITH f AS (SELECT CASE WHEN o_totalprice < 50000 THEN 'ZERO_START_PRICE' END AS flag FROM orders UNION ALL SELECT CASE WHEN o_custkey % 7 = 0 THEN 'MISSING_KPP' END FROM orders UNION ALL SELECT CASE WHEN o_orderstatus = 'P' THEN 'MISSING_SUBJECT' END FROM orders)
 SELECT flag, count(*) AS n FROM f WHERE flag IS NOT NULL GROUP BY flag"""
)
def quality_flag_counts(spark, sf_dir):
    flags = F.array_compact(F.array(F.when(F.col("o_totalprice") < 50000, "ZERO_START_PRICE"), F.when(F.col("o_custkey") % 7 == 0, "MISSING_KPP"), F.when(F.col("o_orderstatus") == "P", "MISSING_SUBJECT")))
    return table(spark, sf_dir, "orders").select(F.explode(ingest.sort_flags(flags)).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query(
    """WITH c(check_name, expected, actual) AS (SELECT 'lots', (SELECT count(*) FROM orders), (SELECT count(DISTINCT lot_id) FROM relations)
 UNION ALL SELECT 'items', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM items)
 UNION ALL SELECT 'winners', (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') x), (SELECT count(*) FROM relations WHERE is_winner)
 UNION ALL SELECT 'suppliers', (SELECT count(*) FROM supplier), (SELECT count(DISTINCT supplier_id) FROM relations)) SELECT *, expected = actual AS ok FROM c""",
    "lots relations items",
)
def load_reconciliation(spark, sf_dir):
    """Expected against actual counts of a load."""
    rel, lines = canonical.relations(spark, sf_dir), table(spark, sf_dir, "lineitem")
    n = F.count("*")
    return ingest.checks(
        [
            ("lots", table(spark, sf_dir, "orders").agg(n), rel.agg(F.countDistinct("lot_id"))),
            ("items", lines.agg(n), canonical.items(spark, sf_dir).agg(n)),
            ("winners", lines.filter("l_returnflag = 'R'").select("l_orderkey", "l_suppkey").distinct().agg(n), rel.filter("is_winner").agg(n)),
            ("suppliers", table(spark, sf_dir, "supplier").agg(n), rel.agg(F.countDistinct("supplier_id"))),
        ]
    )


@query("SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(CAST(('0x' || substr(md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderpriority)), 1, 8)) AS BIGINT)) AS BIGINT) AS fingerprint FROM orders GROUP BY 1")
def group_fingerprints(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status")
    return ingest.fingerprint(rows, "status", ["o_orderkey", "o_custkey", "o_orderpriority"])


@query("SELECT l_suppkey AS supplier_id, min(o_orderdate) AS first_seen FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def supplier_first_seen(spark, sf_dir):
    """First-seen register built from two deliveries."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("supplier_id"))
    seen = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("first_seen"), "o_orderstatus"), "o_orderkey")
    return ingest.first_seen(seen.filter("o_orderstatus = 'F'"), seen.filter("o_orderstatus <> 'F'"), "supplier_id", "first_seen")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')")
def idempotent_append(spark, sf_dir):
    """Customers that a second delivery adds to the first."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return ingest.append_new(orders.filter(F.col("o_orderdate") < cut), orders.filter(F.col("o_orderdate") >= cut), ["c_custkey"]).select("c_custkey")
