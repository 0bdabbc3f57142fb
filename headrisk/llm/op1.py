"""op1_quality_rules and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from headrisk.llm.quality import LEAST_SPREAD, MIN_ROWS, MIN_WORDS, REACH, quality_report

NAME = "op1_quality_rules"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    q = F.col("quality")
    return report.select("doc_id", q.n_words.alias("n_words"), q.word_chars.alias("word_chars"), q.n_symbols.alias("n_symbols"),
                         q.n_dup_lines.alias("n_dup_lines"), q.n_repeat_words.alias("n_repeat_words"), q.base_failed.alias("base_failed"), "kept")


_WS = r"[\x20\x09-\x0D]"
_SPREADS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in LEAST_SPREAD.items())
#: Word windows are counted as rows of (document, window); the rest follows the Spark job step by step, in other words.
SQL = f"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
w AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM d WHERE len(words) >= 3),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS times FROM w),
r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE times > 1 GROUP BY doc_id),
c AS (
  SELECT d.doc_id, lang, source, len(words) AS n_words, len(regexp_replace(text, '{_WS}', '', 'g')) AS word_chars,
         len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)),
f AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_symbols * 1000 // greatest(n_words, 1) AS symbol_rate, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_line_rate,
         n_repeat_words * 1000 // greatest(n_words, 1) AS repeat_rate, word_chars * 100 // greatest(n_words, 1) AS word_length
  FROM c),
v AS (
  UNPIVOT (SELECT lang, source, symbol_rate, dup_line_rate, repeat_rate, word_length FROM f WHERE NOT base_failed)
  ON symbol_rate, dup_line_rate, repeat_rate, word_length INTO NAME rate VALUE v),
b AS (
  SELECT lang, source, rate, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bucket FROM v),
q0 AS (SELECT lang, source, rate, count(*) AS n, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3 FROM b GROUP BY ALL),
q1 AS (SELECT lang, rate, count(*) AS n, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3 FROM b GROUP BY ALL),
q2 AS (SELECT rate, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3 FROM b GROUP BY ALL),
t AS (
  SELECT q0.lang, q0.source, q0.rate,
         CASE WHEN q0.n >= {MIN_ROWS} THEN q0.q1 WHEN q1.n >= {MIN_ROWS} THEN q1.q1 ELSE q2.q1 END AS lo,
         CASE WHEN q0.n >= {MIN_ROWS} THEN q0.q3 WHEN q1.n >= {MIN_ROWS} THEN q1.q3 ELSE q2.q3 END AS hi
  FROM q0 JOIN q1 ON q0.lang IS NOT DISTINCT FROM q1.lang AND q0.rate = q1.rate JOIN q2 ON q0.rate = q2.rate),
s AS (SELECT *, {REACH} * greatest(hi - lo, CASE rate {_SPREADS} END) AS reach FROM t),
p AS (
  SELECT lang, source, max(hi + reach) FILTER (rate = 'symbol_rate') AS a, max(hi + reach) FILTER (rate = 'dup_line_rate') AS b,
         max(hi + reach) FILTER (rate = 'repeat_rate') AS c, max(hi + reach) FILTER (rate = 'word_length') AS e,
         max(lo - reach) FILTER (rate = 'word_length') AS g
  FROM s GROUP BY ALL)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(symbol_rate <= p.a AND dup_line_rate <= p.b AND repeat_rate <= p.c AND word_length BETWEEN p.g AND p.e, false) AS kept
FROM f LEFT JOIN p ON f.lang IS NOT DISTINCT FROM p.lang AND f.source IS NOT DISTINCT FROM p.source
"""
