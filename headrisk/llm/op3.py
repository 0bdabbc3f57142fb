"""op3_token_files; tested by an exact round trip, as SQL has no tokenizer."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from headrisk.llm.common import new_path
from headrisk.llm.token_files import read_tokens, write_tokens

NAME = "op3_token_files"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
