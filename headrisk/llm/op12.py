"""op12_mixing_sources and its SQL, which sorts each source by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from headrisk.llm.mixing import MOST, WEIGHTS, mix

NAME = "op12_mixing_sources"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, source_size, [{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
r AS (
  SELECT *, coalesce(sum(source_size) OVER before_it, 0) * {MOST} AS bound_before, coalesce(sum(weight) OVER before_it, 0) AS weight_before,
         sum(source_size) OVER () AS all_sizes, sum(weight) OVER () AS all_weights,
         row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place
  FROM s WINDOW before_it AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
share AS (
  SELECT arg_min(share, place) AS share
  FROM (SELECT *, (all_sizes - bound_before)::DOUBLE / (all_weights - weight_before)::DOUBLE AS share FROM r)
  WHERE share <= {MOST} * source_size / weight::DOUBLE),
t AS (SELECT source, source_size, least(source_size * {MOST}.0::DOUBLE, coalesce(share, 0) * weight) AS target FROM s, share),
c AS (
  SELECT h, source, sum(n) OVER (PARTITION BY source ORDER BY h) - n AS before, n
  FROM (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h))
SELECT doc_id, size, source_size, target,
       (size * list_sum([CASE WHEN 2 * c.before + c.n <= 2 * least(greatest(target - (k - 1) * source_size, 0), source_size) THEN 1 ELSE 0 END
                         FOR k IN range(1, {MOST + 1})]))::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h"""
