"""op2_sentencepiece; tested against the library and by an exact round trip, as SQL has no tokenizer."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from headrisk.llm.sentencepieces import decoded, encode

NAME = "op2_sentencepiece"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and whether they decode to its text. A word mark in a text itself decodes to a space."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), model).withColumn("back", decoded(model))
    plain = F.translate(F.coalesce("text", F.lit("")), "▁", " ")
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), (F.col("back") == plain).alias("round_trip"))
