"""Settings tables of many tenants: defaults, migration of old defaults and formula checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headrisk import constants as C

GROUPS = {"auth": C.AUTH_SCORES, "identity": C.IDENTITY_SCORES,
          "heuristic": C.HEURISTIC_SCORES, "composite": C.COMPOSITE_SCORES}


def _flat(scores: dict) -> dict[str, float]:
    return {k2: float(w) for k, v in scores.items()
            for k2, w in (((f"{k}.{r}", x) for r, x in v.items()) if isinstance(v, dict) else ((k, v),))}


def default_weights(spark: SparkSession) -> DataFrame:
    rows = [(g, k, w) for g, scores in GROUPS.items() for k, w in _flat(scores).items()]
    return spark.createDataFrame(rows, "group string, key string, weight double")


def earlier_profiles(spark: SparkSession) -> DataFrame:
    """Earlier default scores: ``(version, group, entries)`` with entries sorted by key."""
    rows = [(v, g, sorted(_flat(s).items())) for v, g, s in C.EARLIER_SCORES]
    return spark.createDataFrame(rows, "version string, group string, entries array<struct<key:string,weight:double>>")


def merge_weights(stored: DataFrame) -> DataFrame:
    """Stored weights of every tenant laid over the defaults, key by key.

    ``stored(tenant, group, key, weight)``; the few default rows repeat for every tenant through
    an array, so no cross join is needed.
    """
    spark = stored.sparkSession
    entries = F.array(*[F.struct(F.lit(g).alias("group"), F.lit(k).alias("key"), F.lit(w).alias("weight"))
                        for g, s in GROUPS.items() for k, w in _flat(s).items()])
    defaults = (stored.select("tenant").distinct().select("tenant", F.explode(entries).alias("d"))
                .select("tenant", "d.group", "d.key", F.col("d.weight").alias("default_weight")))
    return (defaults.join(stored, ["tenant", "group", "key"], "full_outer")
            .select("tenant", "group", "key", F.coalesce("weight", "default_weight").alias("weight"),
                    F.col("weight").isNotNull().alias("stored")))


def migrate_weights(stored: DataFrame, versions: DataFrame) -> DataFrame:
    """Replace a weight group that equals earlier defaults exactly by today's defaults.

    ``stored(tenant, group, key, weight)`` and ``versions(tenant, version)``. A tenant with a
    version is compared with that version only; one without with all; one up to date with none.
    """
    spark = stored.sparkSession
    groups = stored.groupBy("tenant", "group").agg(
        F.sort_array(F.collect_list(F.struct("key", "weight"))).alias("entries"))
    profiles = earlier_profiles(spark).select(F.col("version").alias("_version"), F.col("group").alias("_group"), F.col("entries").alias("_entries"))
    old = (groups.join(versions, "tenant", "left")
           .join(F.broadcast(profiles),  # a dozen profiles
                 (F.col("group") == F.col("_group")) & (F.col("entries") == F.col("_entries"))
                 & (F.col("version").isNull() | (F.col("version") == F.col("_version"))), "left_semi")
           .where(F.coalesce("version", F.lit("")) != C.SCORES_VERSION).select("tenant", "group"))
    fresh = old.join(F.broadcast(default_weights(spark)), "group").select(
        "tenant", "group", "key", "weight", F.lit(True).alias("migrated"))
    kept = stored.join(old, ["tenant", "group"], "left_anti").select(
        "tenant", "group", "key", "weight", F.lit(False).alias("migrated"))
    return kept.unionByName(fresh)


def read_formulas(formulas: DataFrame) -> DataFrame:
    """First twenty formulas of every tenant, overlong fields cut, unknown modes set to observe."""
    return formulas.where(F.col("pos") < C.FORMULA_MAX_COUNT).select(
        "tenant", "pos", F.left(F.coalesce("id", F.lit("")), F.lit(C.FORMULA_ID_MAX)).alias("id"),
        F.left(F.coalesce("name", F.lit("")), F.lit(C.FORMULA_NAME_MAX)).alias("name"),
        F.left(F.coalesce("expression", F.lit("")), F.lit(C.FORMULA_TEXT_MAX)).alias("expression"),
        F.when(F.col("mode").isin("observe", "add", "disabled"), F.col("mode")).otherwise("observe").alias("mode"))


def formulas_over_limit(formulas: DataFrame) -> DataFrame:
    """The formulas that no run evaluates because their tenant has twenty before them."""
    return formulas.where(F.col("pos") >= C.FORMULA_MAX_COUNT).select(
        "tenant", "pos", F.left(F.coalesce("id", F.lit("")), F.lit(C.FORMULA_ID_MAX)).alias("id"), F.lit("over_limit").alias("error"))


def check_formulas(formulas: DataFrame) -> DataFrame:
    """First problem of every formula of a table, null when it can be kept."""
    fid, name, text = (F.trim(F.coalesce(c, F.lit(""))) for c in ("id", "name", "expression"))
    repeated = formulas.groupBy("tenant", F.trim("id").alias("_id")).agg((F.count("*") > 1).alias("_repeated"))
    rows = formulas.join(repeated, (F.trim("id") == F.col("_id")) & formulas["tenant"].eqNullSafe(repeated["tenant"]), "left") \
        .drop(repeated["tenant"])
    return rows.withColumn("error", F.when(fid == "", "id_required")
                           .when(F.length(fid) > C.FORMULA_ID_MAX, "id_too_long")
                           .when(~fid.rlike("^[a-zA-Z0-9_-]+$"), "id_invalid")
                           .when(F.col("_repeated"), "id_duplicate")
                           .when(F.length(name) > C.FORMULA_NAME_MAX, "name_too_long")
                           .when(text == "", "expression_required")
                           .when(F.length(text) > C.FORMULA_TEXT_MAX, "expression_too_long")
                           .when(~F.coalesce(F.col("mode").isin("observe", "add", "disabled"), F.lit(False)), "invalid_mode")
                           .when((F.col("mode") == "add") & text.rlike(r"\bmatch\s*\("), "match_in_add_mode")
                           ).drop("_id", "_repeated")
