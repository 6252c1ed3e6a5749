"""File sources and sinks: delimited, XML and JSON deliveries, exports.

Rows keep their order in a file by an ordinal from the file's line position,
and every value stays text until it is normalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the three deliveries.
DATASETS = {
    "notices": "publish_date procedure_id lot_id start_price reqnum procedure_name subject is_smp customer_inn customer_kpp is_eshop_or_aisgz".split(),
    "suppliers": "lot_id supplier_inn supplier_kpp is_winner".split(),
    "items": "lot_id product_name okpd2_code".split(),
}

#: Fixed value: the part of a contract document that is read.
CONTRACT = "id string, publishDate string, regNum string, customer struct<inn:string,kpp:string>, priceInfo struct<price:string>, products struct<product:array<struct<name:string,OKPD2:struct<code:string>,price:string>>>, suppliers struct<supplier:array<struct<inn:string,kpp:string,name:string>>>"


def delimited(spark: SparkSession, path: str, dataset: str, sep: str = ";") -> DataFrame:
    """Text columns of a delivery, and ``row_no`` in file order from 1.

    Spark's monotonic ids hold a split's number and the row's place in it; the
    rows of earlier splits of the same file are added from one small table
    with a row per split, so no file meets in one task.
    """
    columns = DATASETS[dataset]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.csv(path, schema=schema, sep=sep, quote='"', escape='"', header=True, encoding="UTF-8", multiLine=False, mode="PERMISSIVE", enforceSchema=True, emptyValue="", nullValue=None)
    rows = rows.withColumn("_file", F.col("_metadata.file_path")).withColumn("_id", F.monotonically_increasing_id())
    rows = rows.withColumns({"_split": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    splits = rows.groupBy("_file", "_split").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    base = splits.select("_file", "_split", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    text = [F.coalesce(c, F.lit("")).alias(c) for c in columns]
    return rows.join(base, ["_file", "_split"]).select((F.col("_base") + F.col("_at") - F.col("_first") + 1).alias("row_no"), *text)


def header_drift(spark: SparkSession, path: str, dataset: str, sep: str = ";") -> list[tuple[str | None, str | None]]:
    """Differences of a file's header from the contract; empty if equal."""
    first = spark.read.text(path).limit(1).collect()
    got = [c.strip().strip('"').lstrip("﻿") for c in first[0][0].split(sep)] if first else []
    want = DATASETS[dataset]
    n = max(len(got), len(want))
    pairs = list(zip(want + [None] * (n - len(want)), got + [None] * (n - len(got))))
    return [(a, b) for a, b in pairs if a != b]


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and SHA-256 of files (binary rows are never collected)."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def lenient(spark: SparkSession, path: str, n_fields: int, sep: str = ";") -> tuple[DataFrame, DataFrame]:
    """Lines with the right number of fields as arrays, and the others."""
    lines = spark.read.text(path).filter(F.trim("value") != "").withColumn("fields", F.split("value", sep))
    good = F.size("fields") == n_fields
    return lines.filter(good).select("fields"), lines.filter(~good).select("value", F.size("fields").alias("n_fields"))


def safe_xml(text: Column, limit: int = 5_000_000) -> Column:
    """Whether a document may be parsed: bounded, no doctype, no entities."""
    return text.isNotNull() & (F.length(text) <= limit) & ~F.upper(text).contains("<!DOCTYPE") & ~F.upper(text).contains("<!ENTITY")


def contracts(documents: DataFrame, text: str = "xml") -> DataFrame:
    """One row per contract, product and supplier arrays parsed from XML."""
    parsed = documents.filter(safe_xml(F.col(text))).withColumn("c", F.from_xml(F.col(text), CONTRACT))
    return parsed.select(
        "c.id", F.to_date("c.publishDate").alias("publish_date"), F.col("c.regNum").alias("reg_num"), F.col("c.customer.inn").alias("customer_inn"), F.col("c.priceInfo.price").try_cast("decimal(19,4)").alias("price"),
        F.col("c.products.product").alias("products"), F.col("c.suppliers.supplier").alias("suppliers"),
    )


def contract_items(parsed: DataFrame) -> DataFrame:
    return parsed.select("id", F.posexplode("products").alias("line", "p")).select("id", (F.col("line") + 1).alias("line_no"), F.col("p.name").alias("name"), F.col("p.OKPD2.code").alias("code"))


def export(rows: DataFrame, path: str, kind: str, columns: list[str]) -> None:
    """Write fixed columns as json, csv or parquet."""
    writer = rows.select(*columns).write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)
