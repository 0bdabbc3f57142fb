"""Readers of messages, settings, contacts and other input tables; writers of the decision log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headrisk import constants as C
from headrisk import schemas
from headrisk.functions.address import strip
from headrisk.operators.facts import headers_from_pairs, lower_header_names
from headrisk.operators.owners import OwnerTables, owner_parameters
from headrisk.settings import Settings


def normalise_headers(messages: DataFrame) -> DataFrame:
    """Headers as a map with lowercase names, from a map or from name/value pairs."""
    kind = messages.schema["headers"].dataType
    fold = lower_header_names if isinstance(kind, T.MapType) else headers_from_pairs
    if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
        messages = messages.withColumn("headers", F.transform_values("headers", lambda _k, v: F.array(v)))
    return messages.withColumn("headers", fold(F.col("headers")))


def load_messages(spark: SparkSession, path: str, fmt: str = "parquet", pairs: bool = False) -> DataFrame:
    """Messages with headers only; bodies live in a table of their own."""
    schema = schemas.MESSAGE_PAIRS if pairs else schemas.MESSAGES
    reader = spark.read if fmt == "parquet" else spark.read.schema(schema)
    return normalise_headers(reader.format(fmt).load(path))


def stream_messages(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    """New mail as a stream of files with the same schema."""
    stream = (spark.readStream.schema(schemas.MESSAGES).option("maxFilesPerTrigger", files_per_trigger)
              .format(fmt).load(path))
    return normalise_headers(stream)


def load_settings_document(spark: SparkSession, path: str) -> DataFrame:
    """Settings documents as nested rows, with ``account_id`` from the file's name; plain trust entries of old documents become exact ones."""
    raw = spark.read.text(path, wholetext=True).withColumn("account_id", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1))
    doc = F.from_json("value", schemas.SETTINGS_JSON)
    plain = F.from_json(F.get_json_object("value", "$.trustedDomains"), "array<string>")
    typed = F.filter(doc["trustedDomains"], lambda d: d["value"].isNotNull())
    legacy = F.transform(F.filter(plain, lambda v: ~v.startswith("{")), lambda v: F.struct(
        v.alias("value"), F.lit("exact").alias("matchType")))
    return raw.select("account_id", doc.alias("d"), F.concat(
        F.coalesce(typed, F.array().cast("array<struct<value:string,matchType:string>>")),
        F.coalesce(legacy, F.array().cast("array<struct<value:string,matchType:string>>"))).alias("trusted")) \
        .select("account_id", "d.*", "trusted").drop("trustedDomains")


def load_owner_settings(spark: SparkSession, path: str) -> OwnerTables:
    """All settings documents below a path as tables, one document per account, named after it."""
    docs = load_settings_document(spark, path)
    s = F.col("settings")
    groups = [("identity", s["layer2Scores"]), ("heuristic", s["heuristicScores"]), ("composite", s["compositeScores"])]
    entry = lambda g, k, v: F.struct(F.lit(g).alias("group"), k.alias("key"), v.alias("weight"))
    none = F.array().cast("array<struct<group:string,key:string,weight:double>>")

    def listed_weights(group: str, scores: Column) -> Column:
        return F.coalesce(F.transform(F.map_entries(scores), lambda e: entry(group, e["key"], e["value"])), none)
    auth = F.coalesce(F.flatten(F.transform(F.map_entries(s["authScores"]), lambda m: F.transform(
        F.map_entries(m["value"]), lambda r: entry("auth", F.concat_ws(".", m["key"], r["key"]), r["value"])))), none)
    weights = docs.select("account_id", F.explode(F.concat(auth, *[listed_weights(g, m) for g, m in groups])).alias("w")).select("account_id", "w.*").where("weight IS NOT NULL")
    options = {"whitelist_score": "whitelistMitigationScore", "address_book_score": "addressBookMitigationScore",
               "address_book_enabled": "addressBookWhitelistEnabled", "move_to_review": "moveToReview",
               "move_high_risk_to_junk": "moveHighRiskToJunk", "alert_enabled": "notifyAfterAssessment",
               "alert_max_score": "notificationMaxScore", "alert_delay_ms": "notificationDelayMs",
               "alert_interval_ms": "notificationMinIntervalMs"}
    versions = docs.select("account_id", s["scoreDefaultsVersion"].alias("version"))

    def listed(column: str, *fields: Column) -> DataFrame:
        return docs.select("account_id", F.posexplode(column).alias("pos", "e")).select("account_id", "pos", *fields)
    kind = F.col("e.matchType").alias("match_type")
    return OwnerTables(
        owner_parameters(weights, versions, docs.select("account_id", *[s[v].alias(k) for k, v in options.items()])),
        listed("trusted", F.col("e.value").alias("value"), kind).drop("pos"),
        listed("manualWhitelist", F.col("e.value").alias("value"), kind),
        listed("senderDomainRules", F.col("e.domain").alias("domain"), kind, F.col("e.score").alias("score")))


def load_settings(spark: SparkSession, path: str) -> Settings:
    """One profile's settings merged over the defaults, old default scores brought up to date."""
    rows = load_settings_document(spark, path).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path}: one settings document expected, {'several' if rows else 'none'} found; see load_owner_settings")
    row = rows[0]
    s = row["settings"].asDict(recursive=True) if row["settings"] is not None else {}
    stored = {"auth": s.get("authScores"), "identity": s.get("layer2Scores"),
              "heuristic": s.get("heuristicScores"), "composite": s.get("compositeScores")}
    version = s.get("scoreDefaultsVersion")
    if version != C.SCORES_VERSION:
        for known, group, scores in C.EARLIER_SCORES:
            if stored[group] == scores and version in (None, known):
                stored[group] = None
    auth = {m: {**C.AUTH_SCORES.get(m, {}), **((stored["auth"] or {}).get(m) or {})}
            for m in {**C.AUTH_SCORES, **(stored["auth"] or {})}}

    def or_default(key, default):
        return default if s.get(key) is None else s[key]
    return Settings(
        trusted_servers=tuple((t["value"], t["matchType"]) for t in row["trusted"] or ()),
        sender_rules=tuple((r["domain"], r["matchType"], r["score"]) for r in row["senderDomainRules"] or ()),
        whitelist=tuple((w["value"], w["matchType"]) for w in row["manualWhitelist"] or ()),
        formulas=tuple((f["id"], f["name"], f["expression"], f["mode"]) for f in row["customFormulas"] or ()),
        auth_scores=auth, identity_scores=stored["identity"] or {}, heuristic_scores=stored["heuristic"] or {},
        composite_scores=stored["composite"] or {},
        whitelist_score=or_default("whitelistMitigationScore", C.WHITELIST_SCORE),
        address_book_score=or_default("addressBookMitigationScore", C.ADDRESS_BOOK_SCORE),
        address_book_enabled=or_default("addressBookWhitelistEnabled", False),
        move_to_review=or_default("moveToReview", True),
        move_high_risk_to_junk=or_default("moveHighRiskToJunk", False),
        alert_enabled=or_default("notifyAfterAssessment", False),
        alert_max_score=or_default("notificationMaxScore", C.ALERT_MAX_SCORE),
        alert_delay_ms=or_default("notificationDelayMs", C.ALERT_DELAY_MS),
        alert_interval_ms=or_default("notificationMinIntervalMs", C.ALERT_INTERVAL_MS))


def contacts_of(address_books: DataFrame) -> DataFrame:
    """Distinct addresses of people; mailing lists are left out."""
    return (address_books.where(F.coalesce("type", F.lit("contact")) == "contact")
            .select(F.explode(F.array("primary_email", "second_email")).alias("address"))
            .select(F.lower("address").alias("address")).where("address <> ''").distinct())


def mx_records(answers: DataFrame) -> DataFrame:
    """Mail exchangers from DNS answers: MX records only, in order of preference per domain."""
    doc = F.from_json("answer", schemas.MX_ANSWER_JSON)
    rows = answers.select("domain", doc.alias("d")).where("d.Status = 0").select(
        "domain", F.posexplode("d.Answer").alias("pos", "a")).where("a.type = 15")
    words = F.split(F.trim("a.data"), r"\s+")
    priority = F.expr("try_cast(regexp_extract(trim(a.data), '^([+-]?[0-9]+)', 1) AS INT)")
    exchange = F.lower(F.regexp_replace(F.get(words, F.lit(1)), r"\.$", ""))
    return (rows.where(F.size(words) >= 2)
            .select("domain", exchange.alias("exchange"), F.coalesce(priority, F.lit(10)).alias("priority"), "pos")
            .where("exchange <> ''").orderBy("domain", "priority", "pos"))


def mx_status(answers: DataFrame) -> DataFrame:
    """Whether each lookup worked; an unknown name simply has no exchangers."""
    status = F.from_json("answer", schemas.MX_ANSWER_JSON)["Status"]
    return answers.select("domain", status.isin(0, 3).alias("ok"),
                          F.when(~F.coalesce(status.isin(0, 3), F.lit(False)), "dns_error").alias("error"))


def snippet_text(body: Column) -> Column:
    text = strip(F.regexp_replace(body, r"\s+", " "))
    return F.when(F.length(text) > C.SNIPPET_MAX, F.concat(F.left(text, F.lit(C.SNIPPET_MAX)), F.lit("…"))) \
        .otherwise(F.when(text != "", text))


def snippets(parts: DataFrame) -> DataFrame:
    """Start of the first plain-text part of every message.

    ``path`` numbers the parts from the root, such as ``0.1.0``; padding makes its order the
    depth-first one. Texts are cut before the shuffle, because only their start is the result.
    """
    order = F.transform(F.split("path", r"\."), lambda p: F.lpad(p, 6, "0"))
    text = snippet_text(F.col("body"))
    return (parts.where(F.lower("content_type").startswith("text/plain"))
            .select("msg_id", order.alias("o"), text.alias("text")).where("text IS NOT NULL")
            .groupBy("msg_id").agg(F.min_by("text", "o").alias("snippet")))


# ------------------------------------------------------------------ sinks

def write_decision_log(entries: DataFrame, path: str) -> None:
    """Append log rows, one directory per day; the newest-1000 bound is a view over this table."""
    entries.withColumn("assessed_on", F.to_date("assessed_at")).write.mode("append").partitionBy("assessed_on") \
        .parquet(path)


def read_decision_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_log(resolved: DataFrame, path: str, settings_json: str = "{}", version: str = "1") -> None:
    """Write resolved log entries as JSON lines; every line carries the envelope fields."""
    resolved.select(
        F.lit(1).alias("schemaVersion"), F.current_timestamp().alias("exportedAt"), F.lit(version).alias("version"),
        F.lit(settings_json).alias("settings"), F.struct(*resolved.columns).alias("entry")).write.mode("overwrite").json(path)


def export_stamp(at: Column) -> Column:
    """Local-time stamp for export names."""
    return F.date_format(at, "yyyyMMdd-HHmmss")
