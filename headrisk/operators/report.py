"""Rule match report: per-rule aggregates, totals, order and pages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headrisk import constants as C
from headrisk.operators.lookups import top_n
from headrisk.settings import Settings

CHECKPOINT_CONF = "spark.checkpoint.dir"


# ------------------------------------------------------------------ keys and order

def layer_of(key: Column) -> Column:
    return (F.when((key == "authserv.untrusted") | key.startswith("auth."), "L1")
            .when(key.startswith("identity."), "L2").when(key.startswith("heuristic."), "L3")
            .when(key.startswith("composite."), "L4")
            .when((key == "sender.rule") | key.startswith("whitelist.") | key.startswith("custom.formula."), "L5"))


def layer_rank(key: Column) -> Column:
    return F.coalesce(F.substring(layer_of(key), 2, 1).cast("int") - 1, F.lit(len(C.LAYERS)))


def rank_in_layer(key: Column) -> Column:
    """Authentication keys by method and result, then listed rules, then the rest."""
    listed = F.create_map(*[F.lit(v) for kv in C.RULE_RANK.items() for v in kv])
    methods = {m: i for i, m in enumerate(C.AUTH_SCORES)}
    results = {f"{m}.{r}": i for m, rs in C.AUTH_SCORES.items() for i, r in enumerate(rs)}
    method = F.regexp_extract(key, r"^auth\.(\w+)\.(\w+)$", 1)
    pair = F.substring(key, F.lit(6), F.length(key))
    of = lambda table, k: F.coalesce(F.try_element_at(
        F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), k), F.lit(99))
    return (F.when((method != "") & ~F.map_contains_key(listed, key), of(methods, method) * 100 + of(results, pair) - 10000)
            .otherwise(F.coalesce(F.try_element_at(listed, key), F.lit(10000))))


def canonical_order(key: Column) -> list[Column]:
    return [layer_rank(key), rank_in_layer(key), key]


def rule_registry(spark) -> DataFrame:
    """Listed rules in canonical order."""
    rows = [(i, key, title, kind, None if score is None else float(score))
            for i, (key, title, kind, score) in enumerate(C.RULES)]
    return spark.createDataFrame(rows, "rank int, key string, title string, type string, default_score double")


def describe_rules(df: DataFrame, key_col: str = "key") -> DataFrame:
    """Add title and type of a rule key, with made-up entries for results and formulas."""
    registry = rule_registry(df.sparkSession).select(
        F.col("key").alias("_key"), F.col("title").alias("_title"), F.col("type").alias("_type"), "default_score")
    key = F.col(key_col)
    method = F.upper(F.regexp_extract(key, r"^auth\.(\w+)\.(\w+)$", 1))
    result = F.regexp_extract(key, r"^auth\.(\w+)\.(\w+)$", 2)
    formula = F.regexp_extract(key, r"^custom\.formula\.(.+)$", 1)
    return (df.join(F.broadcast(registry), key == F.col("_key"), "left")  # at most a few dozen listed rules
            .withColumn("title", F.coalesce(
                "_title", F.when(method != "", F.concat_ws(" ", method, result))
                .when(formula != "", F.concat(F.lit("Custom formula: "), formula)), key))
            .withColumn("type", F.coalesce(
                "_type", F.when(method != "", F.when(result == "pass", "diagnostic").otherwise("risk"))
                .when(formula != "", "risk")))
            .drop("_key", "_title", "_type"))


# ------------------------------------------------------------------ aggregation

def matches(assessments: DataFrame) -> DataFrame:
    """One row per message and rule: summed delta and occurrences.

    Reasons already lie together in one array, so repeated keys fold inside the row.
    """
    keys = F.array_distinct(F.transform("score_reasons", lambda r: r["key"]))
    folded = F.transform(keys, lambda k: F.struct(
        k.alias("key"),
        F.get(F.filter("score_reasons", lambda r: r["key"] == k), F.lit(0))["label"].alias("label"),
        F.aggregate(F.filter("score_reasons", lambda r: r["key"] == k), F.lit(0.0),
                    lambda t, r: t + r["delta"]).alias("delta"),
        F.size(F.filter("score_reasons", lambda r: r["key"] == k)).alias("occurrences")))
    return (assessments.select("msg_id", "score", "classification", F.explode(folded).alias("m"))
            .select("msg_id", "score", "classification", "m.*"))


def rule_report(assessments: DataFrame) -> DataFrame:
    """Per rule: matches, matches without effect and total delta.

    The messages behind a rule stay rows of ``matches`` (see ``rule_messages``): a rule may
    match a third of all mail, which no single row can hold.
    """
    agg = matches(assessments).groupBy("key").agg(
        F.min_by("label", "msg_id").alias("label"),
        F.count("*").alias("match_count"),
        F.count_if(F.col("delta") == 0).alias("zero_delta_match_count"),
        F.sum("delta").alias("total_delta"),
        F.bool_or(F.col("delta") > 0).alias("_up"), F.bool_or(F.col("delta") < 0).alias("_down"))
    moved = (F.col("type") == "diagnostic") & (F.col("_up") | F.col("_down"))
    seen = (F.when(F.col("_up") & ~F.col("_down"), "risk").when(F.col("_down") & ~F.col("_up"), "mitigation"))
    return (describe_rules(agg)
            .withColumn("diagnostic", F.coalesce((F.col("type") == "diagnostic") & ~moved, F.lit(False)))
            .withColumn("type", F.when(moved, seen).otherwise(F.col("type")))
            .withColumn("layer", layer_of(F.col("key")))
            .select("key", "layer", "type", "diagnostic", "title", "label", "match_count",
                    "zero_delta_match_count", "total_delta"))


def rule_messages(assessments: DataFrame, key: str) -> DataFrame:
    """Messages that matched one rule: the rows of ``matches`` with its key, without folding the others."""
    own = F.filter("score_reasons", lambda r: r["key"] == key)
    return assessments.where(F.exists("score_reasons", lambda r: r["key"] == key)).select(
        "msg_id", "score", "classification", F.lit(key).alias("key"), F.get(own, F.lit(0))["label"].alias("label"),
        F.aggregate(own, F.lit(0.0), lambda t, r: t + r["delta"]).alias("delta"), F.size(own).alias("occurrences"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder ``spark.checkpoint.dir``, or a local one where it is unset (tests): what lies behind it runs once."""
    spark = df.sparkSession
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF) or tempfile.mkdtemp(prefix="headrisk-")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def page(df: DataFrame, order: list, number: int, size: int = C.PAGE_SIZE) -> DataFrame:
    """One page of an ordered result with 1-based positions; the page number is clamped.

    The result is stored first, as both its size and its rows are needed.
    """
    size = max(1, int(size))
    df = stored(df, "page")
    total = df.count()
    number = min(max(0, int(number)), max(1, -(-total // size)) - 1)
    rows = df.orderBy(*order).offset(number * size).limit(size)
    # at most one page reaches the single window partition
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order)) + number * size)


#: Ranges that an index is built in, and keys of the sample that borders them.
INDEX_RANGES, INDEX_SAMPLE = 64, 4096


def _key(order: list[str]) -> Column:
    return F.struct(*order)


def _literal(row, schema, order: list[str]) -> Column:
    return F.struct(*[F.lit(row[c]).cast(schema[c].dataType).alias(c) for c in order])


def page_index(df: DataFrame, order: list[str], size: int = C.PAGE_SIZE) -> DataFrame:
    """``(page, position, <order>)``: the key that each page begins with, and the place of its first row.

    ``order`` names columns, ascending, that tell all rows apart. A sample of keys, by hash, borders
    ``INDEX_RANGES`` ranges; ranges are counted, and each is ranked by its own task. The sample decides
    how even the ranges are, never a page. One row per page: store it and read pages by it.
    """
    size = max(1, int(size))
    keys = df.select(*order)
    part = min(1.0, INDEX_SAMPLE / max(keys.count(), 1))
    sample = keys.where(F.pmod(F.xxhash64(*order), F.lit(1_000_000)) < int(part * 1_000_000) + 1).orderBy(*order).collect()
    step = max(1, -(-len(sample) // INDEX_RANGES))
    borders = [_literal(r, keys.schema, order) for r in sample[step::step]]
    # borders are fixed values now, so counting and ranking see the same ranges
    number = F.size(F.filter(F.array(*borders), lambda b: b <= _key(order))) if borders else F.lit(0)
    ranged = keys.withColumn("_range", number)
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy("_range").agg(F.count("*").alias("n")).select(F.col("_range").alias("_r"), before.alias("_before"))  # at most INDEX_RANGES rows
    ranked = ranged.withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    position = F.col("_before") + F.col("_place")
    return (ranked.join(F.broadcast(starts), F.col("_range") == F.col("_r")).where((position - 1) % size == 0)
            .select(((position - 1) / size).cast("long").alias("page"), position.alias("position"), *order))


def read_page(df: DataFrame, index: DataFrame, order: list[str], number: int) -> DataFrame:
    """One page by the range of its keys, with 1-based positions: no offset and no count, however deep it lies. The number is clamped."""
    at = index.where(F.col("page").isin(max(0, int(number)), max(0, int(number)) + 1)).orderBy("page").collect()
    if not at or at[0]["page"] != max(0, int(number)):
        at = index.orderBy(F.desc("page")).limit(1).collect()
    if not at:
        return df.limit(0).withColumn("position", F.lit(0).cast("long"))
    rows = df.where(_key(order) >= _literal(at[0], df.schema, order))
    if len(at) > 1:
        rows = rows.where(_key(order) < _literal(at[1], df.schema, order))
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order)) + F.lit(at[0]["position"] - 1))  # a page's rows


def filter_rules(report: DataFrame, layer: str = "all", include_diagnostic: bool = True) -> DataFrame:
    if layer in C.LAYERS:
        report = report.where(F.col("layer") == layer)
    return report if include_diagnostic else report.where(~F.col("diagnostic"))


def sort_columns(key: str = "matches", direction: str | None = None) -> list[F.Column]:
    """The order of a report's rules: by matches, most first, or by rule in canonical order, unless a direction is given. Unknown keys count as matches."""
    canonical = canonical_order(F.col("key"))
    if key == "rule":
        return [c.desc() if direction == "desc" else c.asc() for c in canonical]
    count = F.col("match_count")
    return [count.asc() if direction == "asc" else count.desc(), *canonical]


def sort_rules(report: DataFrame, key: str = "matches", direction: str | None = None) -> DataFrame:
    return report.orderBy(*sort_columns(key, direction))


def rank_rules(report: DataFrame, key: str = "matches", direction: str | None = None) -> DataFrame:
    """Place of every rule in an order; a report has one row per rule, a few dozen in all."""
    order = Window.orderBy(*sort_columns(key, direction))
    return report.withColumn("place", F.row_number().over(order))


def match_share(match_count: Column, analysed: Column) -> Column:
    return F.when(analysed > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(match_count, analysed))))


def classification_counts(assessments: DataFrame) -> DataFrame:
    """All three classes in one row, zero where none occurs."""
    return assessments.agg(*[
        F.count_if(F.col("classification") == c).alias(c.replace("-", "_")) for c in ("normal", "review", "high-risk")])


# ------------------------------------------------------------------ runs

def resolve_limit(limit: int | None = None, ceiling: int | None = None) -> int | None:
    """Messages of one run; None means all of them. A ceiling is for callers that bound what users may ask for."""
    if limit is None:
        return None
    if not isinstance(limit, int) or isinstance(limit, bool) or limit < 1 or (ceiling and limit > ceiling):
        raise ValueError(f"analysis limit must be an integer from 1 to {ceiling or 'any number'}")
    return limit


def tag_requests(requested: DataFrame, limit: int | None) -> DataFrame:
    """Requests ``(pos, msg_id)`` with what becomes of each: kept, invalid, duplicate or over the limit.

    Only the first ``limit`` distinct ids are kept. An id past the limit is counted as such each
    time, because it was never kept and cannot be repeated.
    """
    checked = requested.withColumn("msg_id", F.expr(
        "CASE WHEN try_cast(msg_id AS DOUBLE) = floor(try_cast(msg_id AS DOUBLE)) THEN try_cast(msg_id AS BIGINT) END"))
    valid = checked.where(F.col("msg_id") >= 0)
    first = valid.groupBy("msg_id").agg(F.min("pos").alias("first_pos"))
    if limit is None:
        kept = first
    else:
        kept = first.orderBy("first_pos").limit(limit)
    kept = kept.select(F.col("msg_id").alias("_id"), F.col("first_pos").alias("_pos"))
    joined = checked.join(kept, F.col("msg_id") == F.col("_id"), "left")
    return joined.select(
        "pos", "msg_id",
        F.when(F.col("msg_id").isNull() | (F.col("msg_id") < 0), "invalid-id")
        .when(F.col("_pos") == F.col("pos"), "kept")
        .when(F.col("_id").isNotNull(), "duplicate")
        .otherwise("over-limit").alias("outcome"))


def run_outcomes(tagged: DataFrame, messages: DataFrame) -> DataFrame:
    """Kept requests without a message or without headers become failures, never zero scores."""
    present = messages.select(F.col("msg_id").alias("_id"), F.col("headers").isNotNull().alias("_readable"))
    return (tagged.join(present, (F.col("msg_id") == F.col("_id")) & (F.col("outcome") == "kept"), "left")
            .withColumn("outcome", F.when(F.col("outcome") != "kept", F.col("outcome"))
                        .when(F.col("_id").isNull(), "not-found")
                        .when(~F.col("_readable"), "read-failed").otherwise("analysed"))
            .drop("_id", "_readable"))


def run_totals(outcomes: DataFrame) -> DataFrame:
    """Requested = analysed + failed + skipped + over the limit, in one row."""
    o = F.col("outcome")
    return outcomes.agg(
        F.count("*").alias("requested"), F.count_if(o == "analysed").alias("analysed"),
        F.count_if(o.isin("not-found", "read-failed", "assessment-failed")).alias("failed"),
        F.count_if(o.isin("invalid-id", "duplicate", "cancelled")).alias("skipped"),
        F.count_if(o == "over-limit").alias("over_limit"))


def run_state(totals: DataFrame, cancelled: bool = False, truncated: bool = False) -> DataFrame:
    problems = F.col("failed") + F.col("skipped") + F.col("over_limit")
    return totals.withColumn("state", F.when(F.lit(cancelled), "cancelled")
                             .when(~F.lit(truncated) & (F.col("requested") == 0), "empty")
                             .when((problems > 0) | F.lit(truncated), "partial").otherwise("complete"))


def order_failures(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("outcome").isin("not-found", "read-failed", "assessment-failed")).orderBy("pos")


def run_report(requested: DataFrame, messages: DataFrame, score, limit: int | None = None,
               ceiling: int | None = None) -> dict[str, DataFrame]:
    """Totals, classes, rules and rejects of one run over requested message ids.

    ``score`` turns messages into assessments, so every message sees the same settings.
    """
    outcomes = run_outcomes(tag_requests(requested, resolve_limit(limit, ceiling)), messages)
    wanted = outcomes.where("outcome = 'analysed'").select("msg_id")
    assessments = score(messages.join(wanted, "msg_id", "left_semi"))
    return {"totals": run_totals(outcomes), "classes": classification_counts(assessments),
            "rules": rule_report(assessments), "rejects": outcomes.where("outcome <> 'analysed'"),
            "assessments": assessments}


# ------------------------------------------------------------------ scope

class ScopeError(ValueError):
    """Date range that cannot be used."""


def scope_by_date(messages: DataFrame, start: str = "", through: str = "") -> DataFrame:
    """Messages sent from the start of one local day to the end of another; either side may be open.

    The half-open bounds are compared with the plain column, so they reach the scan. Messages
    without a date drop out of a dated run only.
    """
    from datetime import date, timedelta
    import re

    def day(text: str, error: str):
        text = (text or "").strip()
        if not text:
            return None
        try:
            if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
                raise ValueError
            return date.fromisoformat(text)
        except ValueError:
            raise ScopeError(error) from None
    lo, hi = day(start, "invalid-from"), day(through, "invalid-through")
    if lo and hi and lo > hi:
        raise ScopeError("inverted")
    kind = messages.schema["sent_at"].dataType.simpleString()
    if lo:
        messages = messages.where(F.col("sent_at") >= F.lit(str(lo)).cast(kind))
    if hi:
        messages = messages.where(F.col("sent_at") < F.lit(str(hi + timedelta(days=1))).cast(kind))
    return messages


def folder_key() -> Column:
    return F.coalesce("folder_id", F.concat_ws("\u0000", "account_id", "folder_path"))


def scope_by_folder(messages: DataFrame, key: str) -> DataFrame:
    """One folder, without folders below it."""
    return messages.where(folder_key() == key)


def scope_by_selection(messages: DataFrame, selected: DataFrame) -> DataFrame:
    """Messages of a selection ``(pos, msg_id)``; each counts once, at its first position."""
    first = selected.groupBy("msg_id").agg(F.min("pos").alias("pos"))
    return messages.join(first, "msg_id")


def apply_limit(scope: DataFrame, order: list, limit: int | None) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` messages, and a row with how many were left out."""
    kept = scope if limit is None else scope.orderBy(*order).limit(limit)
    bound = F.lit(limit).cast("bigint")
    counts = scope.agg(F.count("*").alias("in_scope")).select(
        "in_scope", F.coalesce(F.greatest(F.col("in_scope") - bound, F.lit(0)), F.lit(0)).alias("excluded"))
    return kept, counts


def limit_per_folder(scope: DataFrame, order: list, limit: int) -> DataFrame:
    """The first ``limit`` messages of every folder; parts of a folder keep their heads, whatever the limit is."""
    return top_n(scope, [folder_key()], order, limit, F.col("msg_id"), "rn")


def scope_folders(scope: DataFrame) -> DataFrame:
    """Folders that occur anywhere in the scope, messages beyond a limit included."""
    return scope.select(folder_key().alias("folder_key"), "folder_id", "folder_name", "folder_type").distinct()
