"""op9_simhash_near_dedup; tested against all pairs on a small table, as SQL has no XXH64."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from headrisk.llm.simhash import near_duplicates

NAME = "op9_simhash_near_dedup"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
