"""Canonical procurement views over the star-schema tables.

An order is a lot, its distinct suppliers are its relations (a supplier wins
where one of its lines was returned), its lines are items with a three-level
category code from the part.  Priorities 1 and 2 stand for the platform that
publishes winners only (AIS_GZ), the others for the one that publishes all (EM).
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table

#: Order of a lot's lines in its source.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

SCOPES = {"code": "code", "group": "code_group", "class": "code_class"}


def platform() -> Column:
    return F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "AIS_GZ").otherwise("EM")


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("lot_id"), F.to_date("o_orderdate").alias("publish_date"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("price"), platform().alias("platform")
    )


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The lines and their number (from the files' footers), which deals lots
    over tasks: what is known of a lot lies in one task, so views meet there."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.withColumnRenamed("l_orderkey", "lot_id"), lines.count()


def _dealt(dated: DataFrame, lines: int) -> DataFrame:
    """Lots dealt like their lines; a task's are few, so they meet by hash and nothing is sorted."""
    return spread(dated, lines, "lot_id").hint("shuffle_hash")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lot and supplier; repeated lines are one relation."""
    whole, n = _lines(spark, sf_dir)
    rows = whole.select("lot_id", F.col("l_suppkey").alias("supplier_id"), (F.col("l_returnflag") == "R").alias("_won"))
    lines = spread(rows, n, "lot_id").groupBy("lot_id", "supplier_id").agg(F.bool_or("_won").alias("is_winner"))
    dated = lots(spark, sf_dir).select("lot_id", "publish_date", "platform")
    return lines.join(_dealt(dated, n), "lot_id")


def code_parts() -> list[Column]:
    group = F.concat_ws(".", "p_type", "p_brand")
    return [F.concat_ws(".", "p_type", "p_brand", F.col("p_size").cast("string")).alias("code"), group.alias("code_group"), F.col("p_type").alias("code_class")]


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line, with the lot's date so that cut-offs need no join."""
    whole, n = _lines(spark, sf_dir)
    lines = whole.select("lot_id", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), *code_parts())
    dated = lots(spark, sf_dir).select("lot_id", "publish_date")
    named = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).drop("p_partkey")
    return spread(named, n, "lot_id").join(_dealt(dated, n), "lot_id").select("lot_id", "publish_date", "name", "code", "code_group", "code_class", F.col("l_partkey").alias("part"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product texts and category codes of mixed depth for the search.

    Every third size has a model mark behind the name.  A code is type, brand
    and the two digits of the size; sizes that end in 5 stop at the first
    digit, those that end in 0 at the brand, and size 50 has no code."""
    size = F.col("p_size")
    mark = F.concat(F.lit(" b"), F.split("p_brand", "#")[1], F.lit("-"), size.cast("string"))
    text = F.concat("p_name", F.when(size % 3 == 0, mark).otherwise(""))
    group = F.concat_ws(".", "p_type", "p_brand")
    tens, ones = F.floor(size / 10).cast("string"), (size % 10).cast("string")
    kind = F.when(size % 10 != 0, F.concat_ws(".", group, tens))
    code = F.when(size % 10 == 0, group).when(size % 10 == 5, kind).otherwise(F.concat_ws(".", group, tens, ones))
    has = lambda c: F.when(size != 50, c)
    none = F.lit(None).cast("string")
    levels = F.struct(has(code).alias("code"), has(F.col("p_type")).alias("class"), none.alias("subclass"), has(group).alias("group"), none.alias("subgroup"), has(kind).alias("kind"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), text.alias("text"), levels.alias("code"))


def product_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per product of a lot: lot_id, part, line (the first), publish_date, text, code."""
    whole, n = _lines(spark, sf_dir)
    rows = whole.select("lot_id", F.col("l_partkey").alias("part"), "l_linenumber")
    lines = spread(rows, n, "lot_id").groupBy("lot_id", "part").agg(F.min("l_linenumber").alias("line"))
    dated = lots(spark, sf_dir).select("lot_id", "publish_date")
    return lines.join(_dealt(dated, n), "lot_id").join(products(spark, sf_dir), "part").select("lot_id", "part", "line", "publish_date", "text", "code")


def subjects(items: DataFrame) -> DataFrame:
    """A lot's subject: the text of its first line (of several the smallest part's)."""
    return items.groupBy("lot_id").agg(F.min_by("text", F.struct("line", "part")).alias("subject"))


def visible(as_of: date, column: str = "publish_date") -> Column:
    """The one temporal rule: strictly before the cut-off."""
    return F.col(column) < F.lit(as_of)


def observed() -> Column:
    """Rows a platform's coverage supports: winners only, or all."""
    return F.when(F.col("platform") == "AIS_GZ", F.col("is_winner")).otherwise(F.col("platform") == "EM")


@dataclass(frozen=True)
class History:
    """Tables as they were known before ``as_of``; no view shows later facts."""

    spark: SparkSession
    sf_dir: str
    as_of: date

    def lots(self) -> DataFrame:
        return lots(self.spark, self.sf_dir).filter(visible(self.as_of))

    def relations(self) -> DataFrame:
        return relations(self.spark, self.sf_dir).filter(visible(self.as_of))

    def observed(self) -> DataFrame:
        return self.relations().filter(observed())

    def items(self) -> DataFrame:
        return items(self.spark, self.sf_dir).filter(visible(self.as_of))

    def product_items(self) -> DataFrame:
        return product_items(self.spark, self.sf_dir).filter(visible(self.as_of))

    def categories(self, scope: str) -> DataFrame:
        """Distinct lot and category value, called ``code``."""
        return self.items().select("lot_id", F.col(SCOPES[scope]).alias("code")).distinct()
