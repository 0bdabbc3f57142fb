"""op8_substring_dedup and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from headrisk.llm.substrings import WINDOW, remove_repeats

NAME = "op8_substring_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    kept = F.when(F.col("_n_removed") > 0, F.col("text")).otherwise(
        F.expr(r"regexp_replace(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' '), '^ | $', '')"))
    return done.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


def words_sql(docs: str) -> str:
    """doc_id, i and w: the words of a table with doc_id and text, and gone: whether a repeated window covers the word."""
    return f"""
  w AS (
    SELECT doc_id, generate_subscripts(words, 1) AS i, unnest(words) AS w
    FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM {docs})),
  x AS (
    SELECT doc_id, i, string_agg(w, ' ') OVER p AS span, count(*) OVER p AS n
    FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
  y AS (
    SELECT doc_id, i, row_number() OVER (PARTITION BY span ORDER BY doc_id, i) > 1 AS again FROM x WHERE n = {WINDOW}),
  z AS (
    SELECT w.doc_id, w.i, w.w, coalesce(bool_or(y.again) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW), false) AS gone
    FROM w LEFT JOIN y ON w.doc_id = y.doc_id AND w.i = y.i)"""


SQL = f"""
WITH {words_sql('documents')}
SELECT d.doc_id, count(z.i) AS n_words, count(z.i) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(z.w, ' ' ORDER BY z.i) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN z ON d.doc_id = z.doc_id GROUP BY d.doc_id
"""
