"""Raw staging of deliveries: lines exactly as they came, with their file order,
their fields under a repaired header, and bad lines beside good ones.

One pass over the files writes the staged lines; everything else reads those.
A line's number is its place in its part of a file plus the lines of earlier
parts, one row a part, so no file meets in one task.  A quoted value may hold
separators and doubled quotes, but no line break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from .files import DATASETS

#: One field behind its separator: quoted with doubled quotes, or plain.
_FIELD = '{sep}(?:"([^"]*+(?:""[^"]*+)*+)"|([^{sep}]*))'


def fields(line: Column, sep: str = ";") -> Column:
    """Values of a line, quotes taken off; null for a null line.  What stands
    between a closing quote and the separator is dropped; a value whose quote
    never closes ends at the separator and keeps it."""
    quoted, plain = (F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(_FIELD.format(sep=sep)), F.lit(i)) for i in (1, 2))
    return F.zip_with(quoted, plain, lambda q, p: F.when(p != "", p).otherwise(F.replace(q, F.lit('""'), F.lit('"'))))


def staged(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1, in file order) and line of every line, written once.

    A mark of byte order and a carriage return are no part of a line; empty
    lines keep their numbers."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("_id"))
    held = written(lines.select("file", F.rtrim(F.ltrim("line", F.lit("﻿")), F.lit("\r")).alias("line"), F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    parts = held.groupBy("file", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("file", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return held.join(base, ["file", "_part"]).select("file", (F.col("_base") + F.col("_at") - F.col("_first") + 1).alias("line_no"), "line")


def header(lines: DataFrame, dataset: str, malformed: list[str], sep: str = ";") -> DataFrame:
    """file, columns and repaired: a file's header, or the contract's where a
    name of the header is known to be malformed."""
    names = F.transform(fields(F.col("line"), sep), lambda c: F.trim(c))
    repaired = F.arrays_overlap("columns", F.array(*map(F.lit, malformed)).cast("array<string>"))
    contract = F.array(*map(F.lit, DATASETS[dataset]))
    first = lines.filter("line_no = 1").select("file", names.alias("columns"))
    return first.select("file", F.when(repaired, contract).otherwise(F.col("columns")).alias("columns"), F.coalesce(repaired, F.lit(False)).alias("repaired"))


def delivered(lines: DataFrame, dataset: str, malformed: list[str], sep: str = ";") -> DataFrame:
    """Every line behind the header: file, line_no, the contract's columns and
    ``warning``.

    Columns are found by the name in the file's own header, whatever their
    order; a column that the file hasn't got is null.  A line with another
    number of fields than the header has null columns and says so; empty lines
    are left out."""
    told = header(lines, dataset, malformed, sep)
    # one row a file, of a header's length
    rows = lines.filter("line_no > 1 and line <> ''").join(told, "file").withColumn("_f", fields(F.col("line"), sep))
    fits = F.size("_f") == F.size("columns")
    value = lambda c: F.when(fits, F.trim(F.get("_f", (F.array_position("columns", F.lit(c)) - 1).cast("int"))))
    warning = F.when(~fits, F.concat(F.size("_f").cast("string"), F.lit(" fields, expected "), F.size("columns").cast("string"), F.lit("; row skipped")))
    return rows.select("file", "line_no", *[F.when(F.array_contains("columns", c), value(c)).alias(c) for c in DATASETS[dataset]], warning.alias("warning"))
