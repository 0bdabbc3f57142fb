"""op4_document_fingerprints; tested against a plain loop, as SQL has no such hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from headrisk.llm.ctph import compare_with_next

NAME = "op4_document_fingerprints"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
