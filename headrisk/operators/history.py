"""Decision-log analytics: rescoring, export, lookups and summaries.

A log row is an assessment with ``assessed_at``, the planned action and the servers seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headrisk import constants as C
from headrisk.functions.address import header, message_id_variants, strip
from headrisk.functions.binding import computed
from headrisk.operators.auth import alignment_metrics, parse_auth_results
from headrisk.operators.lookups import lookup_join, salted_join, top_n
from headrisk.operators.scoring import classify
from headrisk.settings import Settings


def full_log_entries(assessed: DataFrame, assessed_at: Column, action: Column) -> DataFrame:
    """Complete log rows of fully assessed messages: every group of facts, the first server seen and the action taken."""
    first = F.get("auth", F.lit(0))
    named = assessed.select("*", logged_servers(F.col("auth")).alias("_servers"))
    return named.select(
        "msg_id", "account_id", assessed_at.alias("assessed_at"), F.coalesce("subject", F.lit("")).alias("subject"), "from_domain",
        F.col("_servers.ids").alias("authserv_ids"), F.col("_servers.truncated").alias("authserv_ids_truncated"),
        F.coalesce(first["authserv_id"], F.lit("")).alias("authserv_id"), first["trusted"].alias("trusted"),
        "score", "classification", "score_reasons",
        F.struct("random_label", "random_local").alias("heuristic_metrics"), F.col("name_facts").alias("display_name_metrics"),
        alignment_metrics().alias("alignment_metrics"), F.col("message_id_facts").alias("message_id_metrics"),
        F.col("header_facts").alias("header_metrics"), F.col("from_parse").alias("from_parse_metrics"),
        F.struct("rfc_message_id", F.col("account_id").alias("initial_account_id"), F.col("folder_id").alias("initial_folder_id"),
                 F.col("folder_name").alias("initial_folder_name"), F.col("folder_type").alias("initial_folder_type")).alias("message_identity"),
        F.struct("sender_address", "exact").alias("sender_identity"), action.alias("action"), "formula_diagnostics",
        "rfc_message_id", F.col("alignment.any_dkim_aligned").alias("any_dkim_aligned"))


def log_heads(messages: DataFrame, assessed_at: Column, settings: Settings) -> DataFrame:
    """What a log row knows of a message before any score: for jobs that ask who, when and by which servers."""
    own = messages.select("msg_id", "account_id", "subject", assessed_at.alias("assessed_at"),
                          strip(header(F.col("headers"), "message-id")).alias("rfc_message_id"),
                          parse_auth_results(F.col("headers"), settings).alias("auth"))
    return own.select("msg_id", "account_id", "subject", "assessed_at", "rfc_message_id", logged_servers(F.col("auth")).alias("s")).select(
        "msg_id", "account_id", "subject", "assessed_at", "rfc_message_id", F.col("s.ids").alias("authserv_ids"),
        F.col("s.truncated").alias("authserv_ids_truncated"))


def log_entries(assessed: DataFrame, assessed_at: Column, settings: Settings) -> DataFrame:
    """Log rows of fully assessed messages (``scoring.assess``)."""
    named = assessed.select("*", logged_servers(F.col("auth")).alias("_servers"))
    return named.select(
        "msg_id", "account_id", "subject", "from_domain", assessed_at.alias("assessed_at"),
        F.col("_servers.ids").alias("authserv_ids"), F.col("_servers.truncated").alias("authserv_ids_truncated"),
        "score", "classification", "score_reasons", "rfc_message_id", "formula_diagnostics",
        F.col("alignment.any_dkim_aligned").alias("any_dkim_aligned"))


def logged_servers(auth: Column) -> Column:
    """Distinct server ids, trusted ones first, at most five, and whether some were left out."""
    named = F.transform(F.filter(auth, lambda a: (a["authserv_id"] != "")
                                 & (F.length(a["authserv_id"]) <= C.AUTHSERV_ID_MAX)),
                        lambda a: F.struct(F.lower(a["authserv_id"]).alias("id"), a["trusted"].alias("trusted")))
    of = lambda keep: F.transform(F.filter(named, keep), lambda a: a["id"])
    ids = F.array_distinct(F.concat(of(lambda a: a["trusted"]), of(lambda a: ~a["trusted"])))
    return F.struct(F.slice(ids, 1, C.LOGGED_SERVERS_MAX).alias("ids"),
                    (F.size(ids) > C.LOGGED_SERVERS_MAX).alias("truncated"))


# ------------------------------------------------------------------ rescoring

def rescored_reasons(settings: Settings) -> Column:
    """Stored reasons with the delta they would have under ``settings``.

    Sender rules, formulas and unknown composites keep their stored delta: nothing stored says
    whether they would match again.
    """
    known = {f"identity.{k}": settings.identity(k) for k in C.IDENTITY_SCORES}
    known |= {f"heuristic.{k}": settings.heuristic(k) for k in ("randomFromDomainLabel", "randomFromLocalPart")}
    known |= {f"composite.{k}": float(v) for k, v in settings.composites().items()}
    known |= {"whitelist.manual": float(settings.whitelist_score),
              "whitelist.addressBook": float(settings.address_book_score), "authserv.untrusted": 0.0}
    table = F.create_map(*[F.lit(v) for kv in known.items() for v in kv])
    weights = settings.auth_weights()
    penalised = [k for k in ("heuristic.randomFromDomainLabel", "heuristic.randomFromLocalPart") if known[k] > 0]
    effective = (F.exists("score_reasons", lambda r: r["key"].isin(penalised))
                 if penalised and settings.heuristic("layer3Cap") > 0 else F.lit(False))

    def current(r: Column) -> Column:
        key = r["key"]
        is_auth = key.rlike(r"^auth\.\w+\.\w+$")
        return (F.when((key == "composite.dkimAlignedLexicalMitigation") & ~effective, 0.0)
                .when(is_auth, F.coalesce(F.try_element_at(weights, F.substring(key, F.lit(6), F.length(key))), F.lit(0.0)))
                .otherwise(F.coalesce(F.try_element_at(table, key), r["delta"])))
    moved = F.transform("score_reasons", lambda r: F.struct(r.alias("r"), current(r).alias("current_delta")))
    return F.transform(moved, lambda m: F.struct(
        m["r"]["seq"].alias("seq"), m["r"]["key"].alias("key"), m["r"]["label"].alias("label"),
        m["r"]["delta"].alias("delta"), m["current_delta"].alias("current_delta"),
        (m["current_delta"] != m["r"]["delta"]).alias("delta_changed")))


def rescore(log: DataFrame, settings: Settings) -> DataFrame:
    """What-if: current score and class of every log row, with the reasons that would change."""
    total = lambda pick: F.aggregate(F.filter("reasons", pick), F.lit(0.0),
                                     lambda t, r: t + r["current_delta"])
    heuristic = lambda r: r["key"].startswith("heuristic.")
    scored = (log.withColumn("reasons", rescored_reasons(settings))
              .withColumn("current_score", total(lambda r: ~heuristic(r))
                          + F.least(total(heuristic), F.lit(settings.heuristic("layer3Cap")))))
    return scored.select(
        *[c for c in log.columns if c not in ("score", "classification", "score_reasons")],
        F.col("score").alias("original_score"), "current_score",
        F.coalesce("classification", classify(F.col("score"))).alias("original_classification"),
        classify(F.col("current_score")).alias("current_classification"), "reasons",
        F.filter("reasons", lambda r: r["delta_changed"]).alias("reason_diffs"))


# ------------------------------------------------------------------ newest entries

#: Order of "newest": by name, as a Column needs a running session.
NEWEST_FIRST = ["assessed_at DESC NULLS LAST", "msg_id DESC NULLS LAST"]


def recent(log: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` entries of the whole log."""
    return log.orderBy(F.desc("assessed_at"), F.desc("msg_id")).limit(n)


def has_more(log: DataFrame, n: int) -> DataFrame:
    return log.limit(n + 1).agg((F.count("*") > n).alias("has_more"))


def newest_per_account(log: DataFrame, n: int = C.STATUS_SAMPLE) -> DataFrame:
    """Newest ``n`` entries of every account.

    Tasks keep only the newest ``n`` rows of a part of an account, so a busy account costs no more
    than a quiet one.
    """
    return top_n(log, ["account_id"], NEWEST_FIRST, n, F.col("msg_id"), "rn")


def retain_latest(log: DataFrame, n: int = C.LOG_MAX, owner: str = "account_id") -> DataFrame:
    """Bounded view of the append-only log, per mailbox owner."""
    return top_n(log, [owner], NEWEST_FIRST, n, F.col("msg_id"), "_rn").drop("_rn")


def activity_summary(log: DataFrame) -> DataFrame:
    cls = F.coalesce("classification", classify(F.coalesce("score", F.lit(0.0))))
    return log.agg(F.count("*").alias("total"), *[
        F.count_if(cls == c).alias(c.replace("-", "_")) for c in ("normal", "review", "high-risk")])


def last_formula_results(log: DataFrame, n: int = 50) -> DataFrame:
    """Newest diagnostic of every formula among the newest ``n`` entries."""
    recent_rows = recent(log, n).select("assessed_at", "msg_id", F.posexplode("formula_diagnostics").alias("i", "d"))
    return (recent_rows.groupBy(F.col("d.id").alias("id"))
            .agg(F.max_by("d", F.struct("assessed_at", "msg_id", -F.col("i"))).alias("diagnostic")))


# ------------------------------------------------------------------ texts

def number_text(n: Column) -> Column:
    """A number without a trailing ``.0``."""
    return F.when(n == F.floor(n), n.cast("bigint").cast("string")).otherwise(n.cast("string"))


def delta_text(n: Column) -> Column:
    return F.when(n > 0, F.concat(F.lit("+"), number_text(n))).otherwise(number_text(n))


def reason_text(reason: Column) -> Column:
    """Label, delta and the most telling context of a reason."""
    ctx = reason["ctx"]
    get = lambda k: F.try_element_at(ctx, F.lit(k))
    note = (F.when(F.coalesce(get("authserv_id"), F.lit("")) != "", F.concat(F.lit("("), get("authserv_id"), F.lit(")")))
            .when(reason["key"] == "heuristic.randomFromDomainLabel",
                  F.concat(F.lit("(label: "), get("matched_label"), F.lit(")")))
            .when(get("domain").isNotNull(), F.concat(
                F.lit("("), F.concat_ws(" ", get("domain"), get("match_type")), F.lit(")"))))
    head = F.concat(F.coalesce(reason["label"], reason["key"]), F.lit(": "), delta_text(reason["delta"]))
    return F.concat_ws(" ", head, note)


def reason_context(reasons: DataFrame) -> DataFrame:
    """Context pairs of exploded reasons."""
    return reasons.select("msg_id", "seq", "key", F.explode(F.map_entries("ctx")).alias("e")).select(
        "msg_id", "seq", "key", F.col("e.key").alias("ctx_key"), F.col("e.value").alias("ctx_value"))


def non_zero_reasons(reasons: Column) -> Column:
    """Reasons that move the score; a recalculated delta is preferred where there is one."""
    return F.filter(reasons, lambda r: r["delta"] != 0)


def top_reasons(reasons: Column, n: int = 3) -> Column:
    """The ``n`` strongest reasons, ties in evaluation order."""
    order = F.array_sort(F.transform(non_zero_reasons(reasons), lambda r: F.struct(
        (-F.abs(r["delta"])).alias("strength"), r["seq"].alias("seq"))))
    return F.transform(F.slice(order, 1, n), lambda o: F.get(F.filter(reasons, lambda r: r["seq"] == o["seq"]), F.lit(0)))


def top_reasons_text(reasons: Column, n: int = 3) -> Column:
    return F.array_join(F.transform(top_reasons(reasons, n), lambda r: F.concat(
        F.coalesce(r["label"], r["key"]), F.lit(": "), delta_text(r["delta"]))), " · ")


def protective_facts(log: DataFrame) -> DataFrame:
    """What spoke for a message: mitigations in order, then alignment, missing trust and the margin."""
    has_risk = F.exists("score_reasons", lambda r: r["delta"] > 0)
    untrusted = F.exists("score_reasons", lambda r: r["key"] == "authserv.untrusted")
    any_auth = F.exists("score_reasons", lambda r: r["key"].startswith("auth."))
    fact = lambda name, key=None, delta=None, threshold=None: F.struct(
        F.lit(name).alias("fact_key"), (key if key is not None else F.lit(None).cast("string")).alias("score_key"),
        (delta if delta is not None else F.lit(None).cast("double")).alias("delta"),
        F.lit(threshold).cast("int").alias("threshold"))
    facts = F.concat(
        F.transform(F.filter("score_reasons", lambda r: r["delta"] < 0),
                    lambda r: fact("mitigation", r["key"], r["delta"])),
        F.array_compact(F.array(
            F.when(F.col("any_dkim_aligned") & has_risk, fact("dkimAligned")),
            F.when(untrusted & ~any_auth, fact("noTrustedAuth")),
            F.when((F.col("score") > 0) & (F.col("score") < C.REVIEW_THRESHOLD),
                   fact("belowThreshold", threshold=C.REVIEW_THRESHOLD))
            .when((F.col("score") > 0) & (F.col("score") < C.HIGH_RISK_THRESHOLD),
                  fact("belowThreshold", threshold=C.HIGH_RISK_THRESHOLD)))))
    return log.select("msg_id", F.posexplode(facts).alias("fact_order", "f")).select("msg_id", "fact_order", "f.*")


# ------------------------------------------------------------------ export

def export_verdict(found: Column, folder_id: Column, folder_name: Column, folder_type: Column, junk: Column,
                   review_ids: list[str]) -> Column:
    return (F.when(junk, "spam").when(~found, "unknown")
            .when(folder_id.isin(review_ids) if review_ids else F.lit(False), "undecided")
            .when(folder_name == C.REVIEW_FOLDER_NAME, "undecided")
            .when(folder_type == "junk", "spam").otherwise("ham"))


#: Buckets of Message-IDs that are counted, and the rows from which one counts as busy, if it also has 16 times the mean.
KEY_BUCKETS, BUSY_ROWS = 1 << 14, 100_000
STATE = ("_match", "current_account_id", "current_folder_id", "current_folder_name", "current_folder_type", "current_junk")


def _hot_buckets(buckets: DataFrame) -> list[int]:
    """Buckets with far more rows than others, fewer than a sixteenth of all."""
    counts = buckets.where("b IS NOT NULL").groupBy("b").agg(F.count("*").alias("n")).collect()
    least = max(BUSY_ROWS, 16 * sum(r.n for r in counts) / KEY_BUCKETS)
    return sorted(r.b for r in counts if r.n > least)


def _met_in_place(keys: DataFrame, box: DataFrame) -> DataFrame:
    """``(msg_id, _variant, _state, _is_own, n)`` of the keys found in the mailbox: both go once, narrow, to the tasks of their Message-ID."""
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = (box.select("_key", F.col("current_account_id").alias("_account"), F.struct(*STATE).alias("_state"), none(keys, "msg_id"), none(keys, "_variant"), F.lit(True).alias("_in_box"))
            .unionAll(keys.select("_key", "_account", F.lit(None).cast(box.select(F.struct(*STATE).alias("s")).schema["s"].dataType).alias("_state"), "msg_id", "_variant", F.lit(False).alias("_in_box")))
            .repartition("_key"))
    first = F.min_by("_state", F.col("_state._match"))
    whole = Window.partitionBy("_key").orderBy("_account").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = (both.withColumn("_own", first.over(Window.partitionBy("_key", "_account")))
            .withColumn("_any", first.over(whole)).withColumn("n", F.count_if("_in_box").over(whole)).where("NOT _in_box AND n > 0"))
    own = F.when(F.col("_account").isNotNull(), F.col("_own"))
    return seen.select("msg_id", "_variant", F.coalesce(own, "_any").alias("_state"), own.isNotNull().alias("_is_own"), "n")


def _met_in_copies(keys: DataFrame, box: DataFrame) -> DataFrame:
    """The same for busy Message-IDs: two lookups, each with one row at most for an entry's key, the best match of the entry's own account, and the
    best match anywhere with the number of all. The entries of a key are dealt to several tasks."""
    first = lambda state: F.min_by(state, F.col(f"{state}._match"))
    own = (box.select("_key", F.col("current_account_id").alias("_account"), F.struct(*STATE).alias("_one"))
           .groupBy("_key", "_account").agg(first("_one").alias("_own"), F.count("*").alias("_n")))
    anywhere = own.groupBy("_key").agg(first("_own").alias("_any"), F.sum("_n").alias("n"))
    met = salted_join(salted_join(keys, anywhere, ["_key"], F.col("msg_id"), "inner"), own, ["_key", "_account"], F.col("msg_id"))
    return met.select("msg_id", "_variant", F.coalesce("_own", "_any").alias("_state"), F.col("_own").isNotNull().alias("_is_own"), "n")


def resolve_log(log: DataFrame, mailbox: DataFrame, review_ids: list[str]) -> DataFrame:
    """Where each logged message lies now, and the verdict that follows.

    Message ids match as written or without brackets, in the entry's own account before others. An
    entry's id is looked up, never paired with its copies: an id that all accounts share costs a row
    per entry. Only busy ids are copied to several tasks; all others meet in the task of their id.
    ``mailbox(msg_id, header_message_id, account_id, folder_id, folder_name, folder_type, junk)``
    """
    keys = log.select("msg_id", F.col("account_id").alias("_account"),
                      F.posexplode(message_id_variants(F.col("rfc_message_id"))).alias("_variant", "_key"))
    box = computed(mailbox, F.col("header_message_id").alias("_key")).where("_key IS NOT NULL").select(
        "_key", F.col("msg_id").alias("_match"),
        F.col("account_id").alias("current_account_id"), F.col("folder_id").alias("current_folder_id"),
        F.col("folder_name").alias("current_folder_name"), F.col("folder_type").alias("current_folder_type"),
        F.col("junk").alias("current_junk"))
    bucket = F.pmod(F.xxhash64("_key"), F.lit(KEY_BUCKETS))
    hot = _hot_buckets(keys.select(bucket.alias("b")).unionAll(box.select(bucket.alias("b"))))
    if not hot:
        met = _met_in_place(keys, box)
    else:
        is_hot = bucket.isin(hot)
        met = _met_in_place(keys.where(~is_hot), box.where(~is_hot)).unionByName(_met_in_copies(keys.where(is_hot), box.where(is_hot)))
    hits = met.groupBy("msg_id").agg(
        F.min_by("_state", F.struct(F.when(F.col("_is_own"), 0).otherwise(1), "_variant", "_state._match")).alias("best"),
        F.sum("n").alias("match_count"))
    found = F.col("best").isNotNull()
    return (log.join(hits, "msg_id", "left").select(
        *log.columns, found.alias("found"), "best.current_account_id", "best.current_folder_id",
        "best.current_folder_name", "best.current_folder_type", "best.current_junk",
        (F.col("match_count") > 1).alias("ambiguous"), F.col("match_count"),
        F.when(~found, F.when(F.col("rfc_message_id").isNull(), "no_message_id")
               .otherwise("not_found_by_message_id")).alias("reason"),
        export_verdict(found, F.col("best.current_folder_id"), F.col("best.current_folder_name"),
                       F.col("best.current_folder_type"), F.col("best.current_junk"), review_ids)
        .alias("export_verdict")))


def find_log_entry(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """Newest log entry of each wanted Message-ID (trimmed, case matters)."""
    ids = wanted.select(F.trim("rfc_message_id").alias("_id")).where("_id <> ''").distinct()
    entry = F.struct("msg_id", "assessed_at", "score", "classification")
    return (log.withColumn("_id", F.trim("rfc_message_id")).join(ids, "_id").groupBy("_id")
            .agg(F.max_by(entry, F.struct("assessed_at", "msg_id")).alias("e"))
            .select(F.col("_id").alias("rfc_message_id"), "e.*"))


def in_review_folder(mailbox: DataFrame, review_folders: DataFrame) -> DataFrame:
    """Configured folder of the account, else the folder with the usual name."""
    folders = review_folders.select("account_id", "review_folder_id")
    return (lookup_join(mailbox, folders, ["account_id"], F.col("msg_id")).select(*mailbox.columns, "review_folder_id")
            .withColumn("in_review", F.when(F.col("review_folder_id").isNotNull(),
                                            F.coalesce(F.col("review_folder_id") == F.col("folder_id"), F.lit(False)))
                        .otherwise(F.coalesce(F.col("folder_name") == C.REVIEW_FOLDER_NAME, F.lit(False)))))
