"""The corpus pipeline: stages over ``documents``, each from one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotlight.llm import pipeline
from lotlight.llm.shared import cut

STAGES = pipeline.STAGES

#: Trained models and samplers are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
