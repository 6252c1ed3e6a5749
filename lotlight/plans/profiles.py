"""Profile queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import profile
from ..session import table
from ..sources import canonical
from .registry import query


@query(
    """WITH s AS (SELECT o_orderpriority AS priority, l_quantity AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY l_quantity) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
 SELECT priority, max(n) AS n, max(CASE WHEN i = least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) THEN v END) AS floor_rank, max(CASE WHEN i = CAST(floor((n - 1) * 0.95) AS BIGINT) THEN v END) AS low_index,
 max(CASE WHEN i = CAST(round_even((n - 1) * 0.95, 0) AS BIGINT) THEN v END) AS round_index, quantile_cont(v, 0.95) AS linear FROM s GROUP BY priority"""
)
def quantile_conventions(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    rows = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority")), "o_orderkey")
    return profile.quantiles(rows, "priority", "l_quantity", 0.95)


@query("SELECT p_name, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 ORDER BY n DESC, p_name LIMIT 20")
def top_product_names(spark, sf_dir):
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return profile.top_counts(lines.select(F.col("l_partkey").alias("p_partkey")).join(parts.select("p_partkey", "p_name"), "p_partkey"), "p_name", 20)


@query("WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT least(n, 6) AS bucket, count(*) AS n FROM c GROUP BY 1")
def items_per_lot_histogram(spark, sf_dir):
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("size"))
    return profile.capped_histogram(sizes, "size", 6)


@query(
    "SELECT platform, year(publish_date) AS year, count(*) AS lots, count(DISTINCT customer) AS customers, count(*) FILTER (WHERE price > 250000) AS large_lots, min(price) AS min_price, max(price) AS max_price FROM lots GROUP BY 1, 2",
    "lots",
)
def coverage_by_platform_and_year(spark, sf_dir):
    lots = canonical.lots(spark, sf_dir)
    return lots.groupBy("platform", F.year("publish_date").cast("long").alias("year")).agg(
        F.count("*").alias("lots"), F.countDistinct("customer").alias("customers"), F.count_if(F.col("price") > 250000).alias("large_lots"), F.min("price").alias("min_price"), F.max("price").alias("max_price")
    )


@query(
    "WITH n AS (SELECT year(publish_date) AS year, supplier_id, count(*) AS awards FROM relations WHERE is_winner GROUP BY 1, 2) SELECT year, supplier_id, awards, rank() OVER (PARTITION BY year ORDER BY awards DESC) AS rank, count(*) OVER (PARTITION BY year, awards) AS ties FROM n",
    "lots relations",
)
def award_ranks(spark, sf_dir):
    won = canonical.relations(spark, sf_dir).filter("is_winner")
    per = won.groupBy(F.year("publish_date").cast("long").alias("year"), "supplier_id").agg(F.count("*").alias("awards"))
    return profile.competition_ranks(per, "year", "awards")


@query(
    "WITH f AS (SELECT supplier_id, customer, r.publish_date, r.lot_id, min(r.publish_date) OVER (PARTITION BY supplier_id, customer) AS first FROM relations r JOIN lots USING (lot_id)) SELECT year(publish_date) AS year, count(*) AS relations, count(*) FILTER (WHERE first < publish_date) AS repeated FROM f GROUP BY 1",
    "lots relations",
)
def repeat_customers(spark, sf_dir):
    lots = canonical.lots(spark, sf_dir).select("lot_id", "customer")
    seen = profile.seen_before(canonical.relations(spark, sf_dir).join(lots, "lot_id"), ["supplier_id", "customer"], "publish_date")
    return seen.groupBy(F.year("publish_date").cast("long").alias("year")).agg(F.count("*").alias("relations"), F.count_if("seen_before").alias("repeated"))


@query("SELECT l_returnflag AS flag, CAST(sum(CAST(l_linenumber AS BIGINT) * l_suppkey) AS DOUBLE) / CAST(sum(l_suppkey) AS DOUBLE) AS mean FROM lineitem GROUP BY 1")
def weighted_means(spark, sf_dir):
    return profile.weighted_mean(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag"), "flag", "l_linenumber", "l_suppkey")


@query(
    """WITH i AS (SELECT DISTINCT part, code_group AS code, name FROM items), n AS (SELECT code_group AS code, name, count(*) AS items FROM items GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY items DESC, name) AS place FROM n)
 SELECT code, name, items, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3""",
    "lots items",
)
def representative_names(spark, sf_dir):
    names = canonical.items(spark, sf_dir).groupBy(F.col("code_group").alias("code"), "name").agg(F.count("*").alias("items"))
    order = Window.partitionBy("code").orderBy(F.desc("items"), "name")
    return names.withColumn("place", F.row_number().over(order)).filter("place <= 3")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def latest_run(spark, sf_dir):
    """The last event of each user."""
    return profile.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).drop("ts")


@query(
    """WITH o AS (SELECT o_custkey AS customer, count(*) AS lots, min(CAST(o_orderdate AS DATE)) AS first_lot, max(CAST(o_orderdate AS DATE)) AS last_lot, count(DISTINCT year(o_orderdate)) AS years, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished FROM orders GROUP BY 1)
 SELECT c_custkey AS customer, c_mktsegment AS segment, n_name AS nation, r_name AS region, coalesce(lots, 0) AS lots, coalesce(years, 0) AS years, coalesce(finished, 0) AS finished, first_lot, last_lot FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN o ON o.customer = c_custkey"""
)
def customer_profiles(spark, sf_dir):
    date = F.to_date("o_orderdate")
    held = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(
        F.count("*").alias("lots"), F.countDistinct(F.year("o_orderdate")).alias("years"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.min(date).alias("first_lot"), F.max(date).alias("last_lot")
    )
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("n_nationkey"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    return people.join(places, "n_nationkey").join(held, "customer", "left").drop("n_nationkey").na.fill(0, ["lots", "years", "finished"])


@query(
    """WITH w AS (SELECT supplier_id, count(*) AS relations, count(*) FILTER (WHERE is_winner) AS awards, count(DISTINCT customer) AS customers, min(r.publish_date) AS first_seen, max(r.publish_date) AS last_seen, count(*) FILTER (WHERE r.platform = 'EM') AS em FROM relations r JOIN lots USING (lot_id) GROUP BY 1),
 t AS (SELECT supplier_id, code_class, count(DISTINCT r.lot_id) AS n FROM relations r JOIN items i ON i.lot_id = r.lot_id GROUP BY 1, 2), b AS (SELECT supplier_id, code_class AS main_class, row_number() OVER (PARTITION BY supplier_id ORDER BY n DESC, code_class) AS place FROM t)
 SELECT supplier_id, n_name AS nation, relations, awards, customers, first_seen, last_seen, em, main_class FROM w JOIN b USING (supplier_id) JOIN supplier ON s_suppkey = supplier_id JOIN nation ON n_nationkey = s_nationkey WHERE place = 1""",
    "lots relations items",
)
def supplier_360(spark, sf_dir):
    """History summary of every supplier."""
    rel = canonical.relations(spark, sf_dir)
    lots = canonical.lots(spark, sf_dir).select("lot_id", "customer")
    facts = rel.join(lots, "lot_id").groupBy("supplier_id").agg(
        F.count("*").alias("relations"), F.count_if("is_winner").alias("awards"), F.countDistinct("customer").alias("customers"), F.min("publish_date").alias("first_seen"), F.max("publish_date").alias("last_seen"), F.count_if(F.col("platform") == "EM").alias("em")
    )
    classes = rel.select("lot_id", "supplier_id").join(canonical.items(spark, sf_dir).select("lot_id", F.col("code_class").alias("main_class")).distinct(), "lot_id").groupBy("supplier_id", "main_class").agg(F.count("*").alias("n"))
    best = classes.withColumn("place", F.row_number().over(Window.partitionBy("supplier_id").orderBy(F.desc("n"), "main_class"))).filter("place = 1").select("supplier_id", "main_class")
    names = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("supplier_id"), F.col("n_name").alias("nation"))
    return facts.join(best, "supplier_id").join(names, "supplier_id")
