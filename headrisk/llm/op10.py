"""op10_line_dedup and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from headrisk.llm.lines import MIN_DOCS, drop_common_lines

NAME = "op10_line_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_common_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                       F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def documents_sql(docs: str) -> str:
    """doc_id, text, n_lines and n_dropped for a table with doc_id and text."""
    return f"""
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped
  FROM (
    SELECT doc_id, i, line, coalesce(times >= {MIN_DOCS}, false) AS gone
    FROM (
      SELECT doc_id, i, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM {docs}))) AS l
    LEFT JOIN (
      SELECT key, count(DISTINCT doc_id) AS times
      FROM (SELECT doc_id, translate(regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM {docs})
      WHERE key <> '' GROUP BY key) AS k USING (key))
  GROUP BY doc_id"""


SQL = f"SELECT doc_id, n_lines, n_dropped, sha256(coalesce(text, '')) AS kept_sha256 FROM ({documents_sql('documents')})"
