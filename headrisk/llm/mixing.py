"""Mixing sources to target weights, with DataFrame functions only.

A text's size is its number of words. Sources, by code point with null last, weigh `weights`, repeating, and share all words by weight; a target stops at
`most` times its source's words, and the excess goes to the others by weight until none is above. A target is met by nested budgets: the k-th takes as
much of the source once more, up to all of it. Each document has a hash, and a budget takes those whose hash lies under a threshold, so a
document that the k-th budget takes is in all earlier ones. The threshold comes from a histogram of words by source and the hash's leading digit (DIGIT
bits). Only the one bucket in which a budget ends is refined by the next digit, until it holds a single hash. No rows are sorted; a window runs over the
buckets of one source, whose number is fixed. The documents of the last hash are taken if at least half of their words fit the budget, so the words taken
differ from the target by half a document at most.

The hash is that of id and text, which makes reruns agree. Rows equal in both have one hash and are taken together.
Nulls: a null text has no words; a null source is a source; a null id counts as empty. Texts of any length are counted whole. Documents without a word are
in the result, and nothing is taken of them; where no document has one, all targets are 0. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from headrisk.llm.common import saved

WEIGHTS = (1, 2, 3)
MOST = 3
#: Bits of the hash, taken as hexadecimal digits of an MD5, and of one refinement.
HASH_BITS, DIGIT = 60, 12
#: A table with this many sources or fewer is broadcast to the documents; a larger one is joined in salted copies.
BROADCAST_SOURCES = 10_000
SALTS = 32

_WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    """The first HASH_BITS bits of the MD5 of id and text."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def ranked(sources: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """Adds `weight` by the place of `source`. Ranges of sources are counted each by its task; only the counts of ranges are summed up in one place."""
    parts = saved(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))  # a row a task
    place = F.col("before") + F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return (parts.join(F.broadcast(starts), "part")
            .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long")).drop("part", "before"))


def with_targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Adds `target` to a saved table of source_size and weight. Each round fixes the targets that would be above their bound."""
    share, all_sizes = None, None
    while True:
        above = F.lit(False) if share is None else F.col("source_size") * most < F.lit(share) * F.col("weight")
        total, bound, left = sources.agg(F.sum("source_size"), F.coalesce(F.sum(F.when(above, F.col("source_size") * most)), F.lit(0)),
                                         F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        again = ((total or 0) - bound) / left if left else 0.0
        if share is not None and again == share:
            return sources.withColumn("target", F.least(F.col("source_size") * F.lit(float(most)), F.lit(share) * F.col("weight")))
        share = again


def _joined(documents: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Documents with the columns of their source, which are named apart. A source that holds most rows is dealt to SALTS tasks."""
    right = sources.withColumnRenamed("source", "_of")
    if few:
        return documents.join(F.broadcast(right), F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    right = right.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = documents.withColumn("_salt", F.col("hash").bitwiseAND(SALTS - 1).cast("int"))
    return left.join(right, F.col("source").eqNullSafe(F.col("_of")) & (F.col("_salt") == F.col("_copy"))).drop("_of", "_salt", "_copy")


def thresholds(documents: DataFrame, sources: DataFrame, few: bool, most: int = MOST) -> DataFrame:
    """source and k to `bound`: the k-th budget takes the documents whose hash is less. documents: source, size, hash; sources: source_size, target."""
    budgets = (sources.select("source", "source_size", "target", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k"))
               .withColumn("budget", F.least(F.greatest(F.col("target") - (F.col("k") - 1) * F.col("source_size"), F.lit(0.0)), F.col("source_size").cast("double"))))
    # all or nothing needs no search
    plain = budgets.select("source", "k", F.when(F.col("budget") >= F.col("source_size"), F.lit(1 << HASH_BITS)).when(F.col("budget") <= 0, F.lit(0)).alias("bound"), "budget")
    done = plain.where("bound IS NOT NULL").select("source", "k", "bound")
    open_ = saved(plain.where("bound IS NULL").select("source", "k", "budget", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("before")), "open-budgets")
    for shift in range(HASH_BITS - DIGIT, -1, -DIGIT):
        if open_.isEmpty():
            break
        inside = F.shiftright("hash", shift + DIGIT) == F.shiftright("low", shift + DIGIT)
        ranges = open_.groupBy("source", "low").agg(F.collect_list(F.struct("k", "budget", "before")).alias("asked"))  # at most `most` in a row
        buckets = (_joined(documents, ranges.drop("asked"), few).where(inside).groupBy("source", "low", F.shiftright("hash", shift).alias("bucket"))
                   .agg(F.sum("size").alias("n"), F.min("hash").alias("first"), F.max("hash").alias("last")))
        until = F.sum("n").over(W.partitionBy("source", "low").orderBy("bucket"))
        # budgets are less than their range's words, so each ends in a bucket: the first whose words reach beyond it
        ends = (_joined(buckets.withColumn("until", until).withColumn("hash", F.col("bucket")), ranges.withColumnRenamed("low", "_low"), few)
                .where("low = _low").withColumn("a", F.explode("asked")).drop("_low", "asked")
                .where((F.col("a.before") + F.col("until") > F.col("a.budget")) & (F.col("a.before") + F.col("until") - F.col("n") <= F.col("a.budget")))
                .select("source", F.col("a.k").alias("k"), F.col("a.budget").alias("budget"), "first", "last", "n", "bucket",
                        (F.col("a.before") + F.col("until") - F.col("n")).alias("before")))
        ends = saved(ends, "ended-budgets")
        taken = 2 * F.col("before") + F.col("n") <= 2 * F.col("budget")
        found = ends.where("first = last").select("source", "k", F.when(taken, F.col("last") + 1).otherwise(F.col("first")).alias("bound"))
        done = done.unionByName(found)
        open_ = ends.where("first <> last").select("source", "k", "budget", F.shiftleft("bucket", shift).alias("low"), "before")
    return done


def mixing_plan(documents: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> tuple[DataFrame, bool]:
    """source, source_size, target and bounds, a row for each source, and whether they are few. documents: source, size, hash."""
    sizes = documents.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = saved(with_targets(saved(ranked(sizes, weights), "weights"), most), "targets")
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    bounds = thresholds(documents, sources, few, most).groupBy(F.col("source").alias("_s")).agg(F.collect_list("bound").alias("bounds"))
    return saved(sources.join(bounds, F.col("source").eqNullSafe(F.col("_s"))).select("source", "source_size", "weight", "target", "bounds"), "mixing-plan"), few


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (size times copies) of every document."""
    documents = saved(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("hash")), "sizes")
    plan, few = mixing_plan(documents.select("source", "size", "hash"), weights, most)
    copies = F.expr("size(filter(bounds, b -> hash < b))")
    return (_joined(documents, plan, few).withColumn("copies", copies)
            .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")))


def mixture(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents of the mix, all columns as they came, each as often as the mix takes it."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "source", size_of(F.col("text")).alias("size"),
                       hash_of(F.col("doc_id"), F.col("text")).alias("hash"))
    plan, few = mixing_plan(saved(rows.select("source", "size", "hash"), "sizes"), weights, most)
    taken = _joined(rows, plan, few).withColumn("copy", F.explode(F.expr("filter(bounds, b -> hash < b)")))
    return taken.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
