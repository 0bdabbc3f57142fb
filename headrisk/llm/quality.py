"""Quality rules with thresholds that follow the data.

Every text gets counts (words, symbols, repeated lines, repeated word windows). From them come four rates, as integers. A
mergeable quantile sketch of each rate is kept per language and source: a log-linear histogram (values under 64 exact, above
that 64 steps to each doubling, so a quantile is at most 1/64 too low). Histograms merge by adding counts, which makes partial sums
before the shuffle, the sketch of a language and that of all rows the same operation. Fences lie three quartile
distances beyond the quartiles; a join brings them back to the rows. A group of fewer than `min_rows` texts uses its language's
sketch, and below that the sketch of all texts.

Nulls: a null text has no words, fails the base rules and enters no sketch; null languages and sources are groups of
their own. Equal rows are judged alike, each on its own. An empty table gives an empty result. Extra columns are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window as W

from headrisk.llm.common import as_came, bounded_batches, carried, saved

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_ROWS = 100
REACH = 3
#: Least quartile distance that a rate is given, in the rate's own unit.
LEAST_SPREAD = {"symbol_rate": 20, "dup_line_rate": 150, "repeat_rate": 120, "word_length": 50}
#: Copies of each threshold row, and parts that each group's rows are dealt to, when both are joined.
SALTS = 16

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
_COUNTS_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """Words, their characters, symbols, lines with a word, those equal to an earlier one, words in repeated 3-word windows."""
    text = text or ""
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    windows = list(zip(words, words[1:], words[2:]))
    n_repeat = 0
    found = Counter(windows)
    if len(found) < len(windows):
        until = 0
        for i, w in enumerate(windows):
            if found[w] > 1:
                n_repeat += i + 3 - max(i, until)
                until = i + 3
    return len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), len(lines), len(lines) - len(set(lines)), n_repeat


@F.arrow_udf(_COUNTS_TYPE)
def counts_of(texts: pa.Array) -> pa.Array:
    rows = [text_counts(t.as_py()) for t in texts]
    columns = zip(*rows) if rows else [[]] * len(COUNTS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=COUNTS)


#: Counting is costly, and the optimizer would copy it into each filter on a count.
counts_of = counts_of.asNondeterministic()


def with_counts(docs: DataFrame) -> DataFrame:
    """Adds `quality`: the counts, the rates and base_failed."""
    q = F.col("_q")
    words, lines = F.greatest(q.n_words, F.lit(1)), F.greatest(q.n_lines, F.lit(1))
    return docs.withColumn("_q", counts_of("text")).withColumn(
        "quality", F.struct(
            *[q[c].alias(c) for c in COUNTS],
            F.expr("_q.n_symbols * 1000 div greatest(_q.n_words, 1)").alias("symbol_rate"),
            F.expr("_q.n_dup_lines * 1000 div greatest(_q.n_lines, 1)").alias("dup_line_rate"),
            F.expr("_q.n_repeat_words * 1000 div greatest(_q.n_words, 1)").alias("repeat_rate"),
            F.expr("_q.word_chars * 100 div greatest(_q.n_words, 1)").alias("word_length"),
            ((q.n_words < MIN_WORDS) | (100 * q.n_repeat_words > MAX_REPEAT_PERCENT * q.n_words)).alias("base_failed"),
        )).drop("_q")


def sketch_bucket(value: str) -> str:
    """The lower end of the sketch's bucket that holds an integer."""
    shift = f"greatest(length(bin({value})) - 6, 0)"
    return f"shiftleft(shiftright({value}, {shift}), {shift})"


def sketches(counted: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group, rate and bucket: how many texts that passed the base rules fall there."""
    pairs = F.array(*[F.struct(F.lit(m).alias("rate"), F.col(f"quality.{m}").alias("v")) for m in LEAST_SPREAD])
    return (counted.where("NOT quality.base_failed").select(*by, F.explode(pairs).alias("x"))
            .groupBy(*by, F.col("x.rate").alias("rate"), F.expr(sketch_bucket("x.v")).alias("bucket")).agg(F.count("*").alias("n")))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    return sketch.groupBy(*by, "rate", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """n, q1 and q3 of each group and rate: the first buckets at which a quarter and three quarters of the texts are reached."""
    group = W.partitionBy(*by, "rate")
    run = (sketch.withColumn("upto", F.sum("n").over(group.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)))
           .withColumn("total", F.sum("n").over(group)))
    return run.groupBy(*by, "rate").agg(
        F.max("total").alias("n"),
        F.min(F.expr("CASE WHEN 4 * upto >= total THEN bucket END")).alias("q1"),
        F.min(F.expr("CASE WHEN 4 * upto >= 3 * total THEN bucket END")).alias("q3"))


def thresholds(sketch: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """lang, source and for each rate its lowest and highest accepted value, from a sketch by lang and source."""
    own = quartiles(sketch, ["lang", "source"])
    lang = quartiles(merged(sketch, ["lang"]), ["lang"]).select(
        F.col("lang").alias("l_lang"), F.col("rate").alias("l_rate"), F.col("n").alias("l_n"), F.col("q1").alias("l_q1"), F.col("q3").alias("l_q3"))
    every = quartiles(merged(sketch, []), []).select(F.col("rate").alias("a_rate"), F.col("q1").alias("a_q1"), F.col("q3").alias("a_q3"))
    joined = (own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("rate") == F.col("l_rate")), "left")
              .join(every, F.col("rate") == F.col("a_rate"), "left"))

    def pick(q: str) -> F.Column:
        return F.when(F.col("n") >= min_rows, F.col(q)).when(F.col("l_n") >= min_rows, F.col(f"l_{q}")).otherwise(F.col(f"a_{q}"))

    least = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v).cast("long")) for k, v in LEAST_SPREAD.items()))
    spread = REACH * F.greatest(F.col("t3") - F.col("t1"), least[F.col("rate")])
    fences = joined.select("lang", "source", "rate", pick("q1").alias("t1"), pick("q3").alias("t3")).select(
        "lang", "source", "rate", (F.col("t1") - spread).alias("low"), (F.col("t3") + spread).alias("high"))
    one = lambda rate, end: F.max(F.when(F.col("rate") == rate, F.col(end)))
    return fences.groupBy("lang", "source").agg(
        *[one(m, "high").alias(f"max_{m}") for m in LEAST_SPREAD], one("word_length", "low").alias("min_word_length"))


def judged(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds `kept`, and the limits of the row's group. A large group's rows meet copies of its limits in several tasks."""
    own = ["_lang", "_source", "_salt"]
    right = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"),
                          F.struct(*[c for c in limits.columns if c not in ("lang", "source")]).alias("limits"))
    left = counted.withColumn("_row_salt", F.pmod(F.xxhash64("doc_id", F.col("quality.word_chars")), F.lit(SALTS)).cast("int"))
    met = left.join(right, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_row_salt") == F.col("_salt")), "left")
    within = F.lit(True)
    for m in LEAST_SPREAD:
        within = within & (F.col(f"quality.{m}") <= F.col(f"limits.max_{m}"))
    within = within & (F.col("quality.word_length") >= F.col("limits.min_word_length"))
    return met.withColumn("kept", ~F.col("quality.base_failed") & F.coalesce(within, F.lit(False))).drop(*own, "_row_salt")


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: its id, language and source, `quality`, `kept` and `limits`, without the text."""
    bounded_batches(docs.sparkSession)
    counted = saved(with_counts(docs.select("doc_id", "lang", "source", "text")).drop("text"), "quality")
    return judged(counted, saved(thresholds(sketches(counted, ["lang", "source"])), "limits"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass the base rules and their group's limits, with their columns as they were."""
    bounded_batches(docs.sparkSession)
    used = ["doc_id", "lang", "source", "text"]
    counted = with_counts(carried(docs, used))
    limits = saved(thresholds(sketches(counted, ["lang", "source"])), "limits")
    return as_came(judged(counted, limits).where("kept"), docs, used)
