"""op13_spelling_variants; tested against all pairs on a small table, as SQL has no CRC-32.

A null id is written as an empty text in `<doc_id>:<run>`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from headrisk.llm.spelling import variants, words_of_letters

NAME = "op13_spelling_variants"
SQL = None
LETTERS, LEAST, TIMES, EVERY = r"A-Za-zÀ-ÿ", 7, 2, 31


def with_slips(doc_id: Column, run: Column) -> Column:
    """The run, or, if EVERY divides the CRC-32 h of id and run, the run without its code point h % length."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % EVERY == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def counted_words(docs: DataFrame) -> DataFrame:
    """word and n: what with_slips leaves of the runs of letters, from LEAST code points and TIMES occurrences on."""
    runs = docs.select("doc_id", F.explode(words_of_letters(F.col("text"), LETTERS, LEAST)).alias("run"))
    words = runs.select(with_slips(F.col("doc_id"), F.col("run")).alias("word")).where(F.char_length("word") >= LEAST)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= TIMES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(counted_words(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
