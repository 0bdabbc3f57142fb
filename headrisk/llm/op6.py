"""op6_html_extraction; tested against hand-written pages, as SQL has no HTML parser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from headrisk.llm.html import extract

NAME = "op6_html_extraction"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
