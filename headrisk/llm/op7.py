"""op7_toxicity; tested by held-out accuracy, as SQL has no such model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from headrisk.llm.toxicity import toxicity

NAME = "op7_toxicity"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
