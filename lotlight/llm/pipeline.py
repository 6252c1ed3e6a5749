"""Stages of the corpus pipeline, each a function of (spark, docs, sf_dir).

``docs`` is read more than once by some stages and must be stable; the runner
writes every stage's result.  All stages but the last return the columns they
were given.

Defined cases: an empty table gives an empty one; a null text has no language and goes
at the first stage; rows with a null or repeated id are documents like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, near_dup, packing, pii
from .queries import PII_KEY
from .shared import cut, read, tune


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no language (null, empty or without letters), or of none for most of their words."""
    tune(spark)
    return langid.keep(docs, langid.train(docs))


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` has."""
    while name in docs.columns:
        name += "_"
    return name


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id (a null one before all), of
    each group.  Rows count, not ids: of rows with one id, those that are no
    copies of each other stay, and of equal rows one stays."""
    tune(spark)
    row, at = (_free(docs, name) for name in ("_row", "_at"))
    rows = cut(docs.withColumn(at, F.monotonically_increasing_id()))
    # the first row of an id goes by the id, all others (few, as a rule) by numbers beyond all ids
    ids = rows.select(at, "doc_id")
    firsts = ids.filter("doc_id is not null").groupBy("doc_id").agg(F.min(at).alias(at))
    others = cut(ids.join(firsts.select(at).hint("merge"), at, "left_anti").select(at))
    if others.take(1):
        beyond = 1 + (rows.agg(F.max("doc_id")).first()[0] or 0)
        rows = rows.join(others.withColumn(row, F.col(at) + F.lit(beyond)).hint("merge"), at, "left").withColumn(row, F.coalesce(row, "doc_id"))
    else:
        rows = rows.withColumn(row, F.col("doc_id"))
    found = near_dup.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"))
    groups = found.select(F.col("doc_id").alias(row), "component_id").join(rows.select(row, "doc_id").hint("merge"), row)
    first = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", row)).alias("first")).select(F.col("first").getField(row).alias(row))
    return rows.join(cut(first).hint("merge"), row, "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    tune(spark)
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data; n_chars follows the text."""
    tune(spark)
    out = pii.replace(docs, PII_KEY)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind)))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left; the last stage."""
    tune(spark)
    return packing.pack(docs, keep_ids=False)


STAGES = [
    ("language id", language),
    ("near-duplicates", near_duplicate),
    ("decontamination", decontaminate),
    ("pii", surrogates),
    ("best-fit packing", pack),
]
