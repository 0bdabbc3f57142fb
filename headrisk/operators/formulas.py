"""User formulas: Spark SQL expressions over a documented context.

Context columns: ``base_score``, ``verdict``, ``from_`` (address, local_part, domain,
registrable_domain, tld, subdomain_depth, left_label_entropy), ``display_name`` (raw, normalized),
``auth`` (dmarc, spf, dkim), ``alignment`` (spf_aligned, any_dkim_aligned, any_auth_aligned),
``message_id`` (domain, registrable_domain, matches_from_domain), ``headers`` (has_list_headers).
Helpers: ``has(key)``, ``scoreOf(key)``, ``min``, ``max``, ``clamp(v, lo, hi)``,
``nameContains(text)`` and, for observing only, ``match(text, pattern[, 'i'])``.

All numbers are doubles: literals, context fields and the helpers that count, so no arithmetic can
overflow. A formula is analysed against an empty table of the context, and its analysed tree may hold
no subquery and no cast that the formula does not ask for: text is never read as a number. What cannot
be used gets a diagnostic; the other formulas still score.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headrisk import constants as C
from headrisk.functions.binding import computed, let
from headrisk.functions.text import entropy
from headrisk.settings import Settings

DIAGNOSTIC_DDL = ("struct<id:string,name:string,mode:string,value:double,error:string,applied:boolean,"
                  "would_change_score:double,would_change_verdict:string>")
HELPERS = {"has": "map_contains_key(reasons, ", "scoreOf": "headrisk_score_of(reasons, ",
           "min": "least(", "max": "greatest(", "clamp": "headrisk_clamp(",
           "nameContains": "headrisk_name_contains(display_name.normalized, ", "match": "headrisk_match(",
           "length": "headrisk_length(", "floor": "headrisk_floor(", "ceil": "headrisk_ceil("}
CONTEXT_DDL = ("base_score double, verdict string, from_ struct<address:string,local_part:string,domain:string,"
               "registrable_domain:string,tld:string,subdomain_depth:double,left_label_entropy:double>, "
               "display_name struct<raw:string,normalized:string>, auth struct<dmarc:string,spf:string,dkim:string>, "
               "alignment struct<spf_aligned:boolean,any_dkim_aligned:boolean,any_auth_aligned:boolean>, "
               "message_id struct<domain:string,registrable_domain:string,matches_from_domain:boolean>, "
               "headers struct<has_list_headers:boolean>, reasons map<string,double>")
ALLOWED = {*HELPERS, "coalesce", "nullif", "ifnull", "if", "abs", "floor", "ceil", "round", "sqrt", "least",
           "greatest", "length", "lower", "upper", "trim", "contains", "startswith", "endswith",
           "try_divide", "try_mod", "try_cast", "isnull", "isnotnull"}
KEYWORDS = {"and", "or", "not", "in", "when", "then", "else", "case", "between", "like", "is"}
_SQL_FUNCTIONS = [
    "headrisk_score_of(m MAP<STRING, DOUBLE>, k STRING) RETURNS DOUBLE "
    "RETURN coalesce(try_element_at(m, k), 0D)",
    "headrisk_clamp(v DOUBLE, lo DOUBLE, hi DOUBLE) RETURNS DOUBLE RETURN least(greatest(v, lo), hi)",
    "headrisk_name_contains(n STRING, x STRING) RETURNS BOOLEAN "
    "RETURN contains(coalesce(n, ''), regexp_replace(lower(coalesce(x, '')), '[^a-z0-9]', ''))",
    "headrisk_match(s STRING, p STRING, f STRING DEFAULT '') RETURNS BOOLEAN "
    "RETURN left(coalesce(s, ''), 512) RLIKE concat(IF(f = 'i', '(?i)', ''), p)",
    "headrisk_length(s STRING) RETURNS DOUBLE RETURN double(length(s))",
    "headrisk_floor(v DOUBLE) RETURNS DOUBLE RETURN double(floor(v))",
    "headrisk_ceil(v DOUBLE) RETURNS DOUBLE RETURN double(ceil(v))",
]
NOT_FINITE = "Formula must return a finite number"
OVER_LIMIT = f"not evaluated: only the first {C.FORMULA_MAX_COUNT} formulas are"
_NUMBER = re.compile(r"(?<![\w.])(\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)(?![\w.])")


class FormulaError(ValueError):
    """A formula that cannot be used; the message goes to its diagnostics."""


def _outside_literals(text: str) -> str:
    return re.sub(r"'(?:[^'\\]|\\.)*'", "''", text)


def check_formula(text: str, mode: str) -> None:
    """Refuse anything but plain expressions over the allowed functions."""
    code = _outside_literals(text)
    if re.search(r"[;`\"\\$@{}\[\]]|--|/\*", code):
        raise FormulaError("only a single expression is allowed")
    if re.search(r"[/%]", code):
        raise FormulaError("use try_divide or try_mod")
    if re.search(r"\(\s*(select|table|values|from|with)\s", code, re.I):
        raise FormulaError("only expressions over the formula context are allowed")
    for kind in re.findall(r"\btry_cast\s*\(.*?\bas\s+(\w+)", code, re.I | re.S):
        if kind.lower() not in ("double", "string", "boolean"):
            raise FormulaError(f"try_cast to double, string or boolean only, not '{kind}'")
    for name in re.findall(r"([A-Za-z_][\w.]*)\s*\(", code):
        if name not in ALLOWED and name.lower() not in KEYWORDS:
            raise FormulaError(f"function not allowed: '{name}'")
    if re.search(r"\bmatch\s*\(", code):
        if mode == "add":
            raise FormulaError("match() is not available in add mode")
        for _s, pattern, flag in re.findall(r"\bmatch\s*\(([^,()]+),\s*'((?:[^'\\]|\\.)*)'\s*(?:,\s*'(\w*)'\s*)?\)", text):
            if len(pattern) > 256:
                raise FormulaError("match(): pattern too long (max 256)")
            if flag not in ("", "i"):
                raise FormulaError(f"match(): unsupported flag '{flag}' (only \"i\" allowed)")
            try:
                re.compile(pattern)
            except re.error as e:
                raise FormulaError(f"match(): {e}") from None
        if len(re.findall(r"\bmatch\s*\(", code)) != len(re.findall(r"\bmatch\s*\([^,()]+,\s*''", code)):
            raise FormulaError("match(): the pattern must be a literal")


def to_sql(text: str) -> str:
    """Outside literals, helper names become Spark expressions and numbers become doubles (places of ``round`` stay whole)."""
    pieces = re.split(r"('(?:[^'\\]|\\.)*')", text)
    names = "|".join(HELPERS)

    def code(piece: str) -> str:
        piece = re.sub(rf"\b({names})\s*\(", lambda m: HELPERS[m.group(1)], piece)
        piece = _NUMBER.sub(r"\1D", piece)
        return re.sub(r"(\bround\s*\([^()]*(?:\([^()]*\)[^()]*)*,\s*-?\d+)D(\s*\))", r"\1\2", piece)
    return "".join(p if p.startswith("'") else code(p) for p in pieces)


def register_helpers(spark: SparkSession) -> None:
    for body in _SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")


def _last_delta_map(reasons: Column) -> Column:
    """Key -> delta; the last delta of a repeated key counts."""
    keys = F.array_distinct(F.transform(reasons, lambda r: r["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(
        F.filter(reasons, lambda r: r["key"] == k), -1)["delta"]))


def formula_context(scored: DataFrame) -> DataFrame:
    """Add the context columns; authentication results are the first of each method."""
    def first_result(method: str) -> Column:
        hit = F.get(F.filter("score_reasons", lambda r: r["key"].startswith(f"auth.{method}.")), F.lit(0))
        return F.split_part(hit["key"], F.lit("."), F.lit(3)).alias(method)
    from headrisk.operators.scoring import classify
    parts, mid = F.col("from_parts"), F.col("message_id_facts")
    return computed(
        scored,
        F.struct(
            F.col("score").alias("base_score"), classify(F.col("score")).alias("verdict"),
            F.struct(F.col("sender_address").alias("address"), F.col("from_local").alias("local_part"),
                     F.col("from_domain").alias("domain"), parts["registrable_domain"].alias("registrable_domain"),
                     parts["public_suffix"].alias("tld"),
                     F.coalesce(parts["subdomain_depth"], F.lit(0)).cast("double").alias("subdomain_depth"),
                     entropy(F.substring_index("from_domain", ".", 1)).alias("left_label_entropy")).alias("from_"),
            F.struct(F.col("name_facts.display_name_raw").alias("raw"),
                     F.col("name_facts.display_name_normalized").alias("normalized")).alias("display_name"),
            F.struct(first_result("dmarc"), first_result("spf"), first_result("dkim")).alias("auth"),
            F.struct("alignment.spf_aligned", "alignment.any_dkim_aligned", "alignment.any_auth_aligned")
            .alias("alignment"),
            F.struct(mid["message_id_domain"].alias("domain"),
                     mid["message_id_registrable_domain"].alias("registrable_domain"),
                     mid["message_id_domain_matches_from_domain"].alias("matches_from_domain")).alias("message_id"),
            F.struct(F.coalesce("header_facts.has_list_headers", F.lit(False)).alias("has_list_headers"))
            .alias("headers"),
            _last_delta_map(F.col("score_reasons")).alias("reasons"),
        ).alias("ctx"))


def empty_context(spark: SparkSession) -> DataFrame:
    """The context without rows: what formulas are analysed against."""
    return spark.createDataFrame([], CONTEXT_DDL)


def _family(kind: str) -> str:
    return kind if kind in ("string", "boolean", "void") else "number"


def check_tree(df: DataFrame) -> None:
    """Refuse subqueries and casts between text, numbers and truth values that were not asked for."""
    plans = [df._jdf.queryExecution().analyzed()]
    while plans:
        plan = plans.pop()
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
        nodes = [plan.expressions().apply(i) for i in range(plan.expressions().size())]
        while nodes:
            node = nodes.pop()
            name = node.getClass().getSimpleName()
            if name.endswith("Subquery") or name in ("Exists", "ListQuery"):
                raise FormulaError("only expressions over the formula context are allowed")
            if name == "Cast" and node.evalMode().toString() != "TRY":
                source, target = _family(node.child().dataType().typeName()), _family(node.dataType().typeName())
                if source not in (target, "void"):
                    raise FormulaError(f"types do not match: {source} where {target} is needed; use try_cast")
            nodes += [node.children().apply(i) for i in range(node.children().size())]


def check_patterns(spark: SparkSession, text: str) -> None:
    """Patterns of ``match`` have to be ones that the executors accept."""
    for literal in re.findall(r"\bmatch\s*\([^,()]+,\s*('(?:[^'\\]|\\.)*')", text):
        try:
            pattern = spark.sql(f"SELECT {literal} AS p").first()["p"]
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        except PySparkException as e:
            raise FormulaError(f"match(): {str(e).splitlines()[0][:200]}") from None


def compile_formula(context: DataFrame, text: str, mode: str) -> Column:
    """Formula as a clamped column over the context; raises FormulaError when it cannot be used."""
    check_formula(text, mode)
    check_patterns(context.sparkSession, text)
    try:
        column = F.expr(to_sql(text))
        checked = context.select(column.alias("v"))
        result = checked.schema["v"].dataType
    except (AnalysisException, ParseException) as e:
        raise FormulaError(str(e).split("\n")[0][:200]) from None
    check_tree(checked)
    if not isinstance(result, T.NumericType):
        raise FormulaError(NOT_FINITE)
    limit = float(C.FORMULA_OUTPUT_LIMIT)

    def clamped(value: Column) -> Column:
        finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
        return F.when(finite, F.least(F.greatest(value, F.lit(-limit)), F.lit(limit)))
    return let(column.cast("double"), clamped)


def apply_formulas(scored: DataFrame, settings: Settings) -> DataFrame:
    """Evaluate the first twenty formulas and add what they contribute.

    Every formula reads the score before any formula. A formula that fails, or comes after the
    twentieth, leaves a diagnostic and changes nothing.
    """
    from headrisk.operators.scoring import classify
    empty = F.array().cast(f"array<{DIAGNOSTIC_DDL}>")
    usable = lambda formulas: [(i, n or i, e, m or "observe") for i, n, e, m in formulas if m != "disabled" and i and e]
    active, late = usable(settings.formulas[:C.FORMULA_MAX_COUNT]), usable(settings.formulas[C.FORMULA_MAX_COUNT:])
    if not active and not late:
        return scored.withColumn("formula_diagnostics", empty)
    register_helpers(scored.sparkSession)
    # score, context and values are computed once a row: each formula's diagnostics read them several times
    scored = computed(scored.withColumnRenamed("score", "_score"), F.col("_score").alias("score")).drop("_score")
    with_ctx = formula_context(scored)
    context = empty_context(scored.sparkSession)
    values: dict[str, Column] = {}
    errors: dict[str, str] = {}
    for pos, (_id, _name, text, mode) in enumerate(active):
        try:
            values[f"v{pos}"] = compile_formula(context, text, mode)
        except FormulaError as e:
            errors[f"v{pos}"] = str(e)
    # formulas see only their context, so their names never meet the columns of the facts
    nested = with_ctx.select(F.struct(*with_ctx.columns).alias("row"), "ctx.*")
    evaluated = computed(nested, F.struct(
        *[values.get(f"v{p}", F.lit(None).cast("double")).alias(f"v{p}") for p in range(len(active))]).alias("fv"))
    back = evaluated.select("row.*", "fv").drop("ctx")

    diagnostics, added = [], []
    for pos, (fid, name, _text, mode) in enumerate(active):
        value, fixed = F.col(f"fv.v{pos}"), errors.get(f"v{pos}")
        ok = value.isNotNull()
        verdict, after = classify(F.col("score")), classify(F.col("score") + value)
        diagnostics.append(F.struct(
            F.lit(fid).alias("id"), F.lit(name).alias("name"), F.lit(mode).alias("mode"), value.alias("value"),
            F.when(~ok, F.lit(fixed or NOT_FINITE)).alias("error"), (ok & F.lit(mode == "add")).alias("applied"),
            F.when(ok, F.col("score") + value).alias("would_change_score"),
            F.when(ok & (after != verdict), F.concat_ws(" -> ", verdict, after)).alias("would_change_verdict")))
        if mode == "add":
            added.append(F.when(ok, F.struct(
                F.lit("L5").alias("layer"), F.lit(f"custom.formula.{fid}").alias("key"), F.lit(name).alias("label"),
                value.alias("delta"), F.create_map(F.lit("formula_id"), F.lit(fid)).alias("ctx"))))
    null = F.lit(None)
    diagnostics += [F.struct(F.lit(fid).alias("id"), F.lit(name).alias("name"), F.lit(mode).alias("mode"), null.cast("double").alias("value"),
                             F.lit(OVER_LIMIT).alias("error"), F.lit(False).alias("applied"), null.cast("double").alias("would_change_score"),
                             null.cast("string").alias("would_change_verdict")) for fid, name, _text, mode in late]
    out = back.withColumn("formula_diagnostics", F.array(*diagnostics))
    if added:
        base = F.size("score_reasons")
        extra = F.transform(F.array_compact(F.array(*added)), lambda r, i: F.struct(
            (base + i).alias("seq"), r["layer"].alias("layer"), r["key"].alias("key"), r["label"].alias("label"),
            r["delta"].alias("delta"), r["ctx"].alias("ctx")))
        out = out.withColumn("_extra", extra)
        out = out.withColumn("score_reasons", F.concat("score_reasons", "_extra")).withColumn(
            "score", F.col("score") + F.aggregate("_extra", F.lit(0.0), lambda t, r: t + r["delta"])).drop("_extra")
    return out.drop("fv")
