"""Cleaning a corpus for training, in five stages.

A stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as the next stage's documents. All but the last
return the columns that the documents came with; `n_chars`, where there is one, follows the text. Each handles nulls, empty texts, repeated rows and
an empty table as its operator's module says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from headrisk.llm.common import saved
from headrisk.llm.lines import drop_common_lines
from headrisk.llm.op5 import digest
from headrisk.llm.packing import pack
from headrisk.llm.quality import keep_good
from headrisk.llm.simhash import keep_first
from headrisk.llm.substrings import remove_repeats


#: Pieces of text that a packing worker remembers: fewer than by default, as the workers of earlier stages still hold memory.
REMEMBERED = 100_000


def _as_before(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The changed documents with the columns of docs."""
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if "n_chars" in docs.columns else None
    return changed.select(*[length if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or their group's limits go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur in ten or more documents go from all of them."""
    return _as_before(docs, drop_common_lines(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words go that are part of a 20-word passage which starts earlier too."""
    return _as_before(docs, remove_repeats(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens, without the ids."""
    return digest(pack(docs, public_tokenizers.path("byte_bpe_50k.json"), remember=REMEMBERED))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]

#: SQL has neither the SimHash's XXH64 nor a tokenizer; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
