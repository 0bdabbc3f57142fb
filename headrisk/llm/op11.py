"""op11_cross_tokenizer_alignment; tested against a plain loop over all pairs of tokens, as SQL has no tokenizer."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from headrisk.llm.alignment import align

NAME = "op11_cross_tokenizer_alignment"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), hashed=True)
    return found.withColumnRenamed("groups", "groups_sha256")
