"""Message assessment: facts, reasons of all layers, score and class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headrisk import constants as C
from headrisk.functions.binding import computed
from headrisk.functions.domains import SuffixRules
from headrisk.operators import formulas as FX
from headrisk.operators import rules as R
from headrisk.operators.facts import with_facts
from headrisk.operators.lookups import lookup_join, with_sender_hits, with_trusted_ids, with_whitelist_hit
from headrisk.settings import Settings, is_long


def classify(score: Column) -> Column:
    return (F.when(score >= C.HIGH_RISK_THRESHOLD, "high-risk")
            .when(score >= C.REVIEW_THRESHOLD, "review").otherwise("normal"))


def total_score(reasons: Column, cap: float | Column) -> Column:
    """Sum of deltas, with the heuristic layer limited to ``cap``."""
    def add(pick) -> Column:
        return F.aggregate(F.filter(reasons, pick), F.lit(0.0), lambda total, r: total + r["delta"])
    return add(lambda r: r["layer"] != "L3") + F.least(add(lambda r: r["layer"] == "L3"), F.lit(cap).cast("double"))


def with_lookups(facts: DataFrame, settings: Settings, contacts: DataFrame | None,
                 account_domains: DataFrame | None) -> DataFrame:
    """Join the two tables that may grow: address books and account identities.

    Both are counted. Within a bound they are broadcast and the wide facts are not moved; larger ones
    are joined by salted keys, as a few accounts or senders may have most of the messages.
    """
    if settings.address_book_enabled and contacts is not None:
        known = contacts.select(F.lower("address").alias("sender_address"), F.lit(True).alias("_known")).distinct()
        facts = (lookup_join(facts, known, ["sender_address"], F.col("msg_id"))
                 .withColumn("in_address_book", F.coalesce("_known", F.lit(False))).drop("_known"))
    else:
        facts = facts.withColumn("in_address_book", F.lit(False))
    if is_long(settings.whitelist):
        facts = with_whitelist_hit(facts, listed(facts, settings.whitelist, "value string, match_type string"))
    if is_long(settings.sender_rules):
        facts = with_sender_hits(facts, listed(facts, settings.sender_rules, "domain string, match_type string, score double"))
    if account_domains is not None:
        return lookup_join(facts, account_domains.select("account_id", "account_domains"), ["account_id"], F.col("msg_id"))
    return facts.withColumn("account_domains", F.lit(None).cast("array<string>"))


def listed(df: DataFrame, entries: tuple, columns: str) -> DataFrame:
    """A settings list as a table with the place of each entry."""
    rows = [(i, *(float(v) if isinstance(v, int) else v for v in e)) for i, e in enumerate(entries)]
    return df.sparkSession.createDataFrame(rows, f"pos int, {columns}")


def score_facts(facts: DataFrame, settings: Settings, need_trusted: bool = False, rule_set: R.RuleSet = R.STANDARD) -> DataFrame:
    """Reasons, score and class of every facts row (after ``with_lookups``)."""
    reasons = F.transform(R.all_reasons(settings, need_trusted, rule_set), lambda r, i: F.struct(
        i.alias("seq"), r["layer"].alias("layer"), r["key"].alias("key"), r["label"].alias("label"),
        r["delta"].alias("delta"), r["ctx"].alias("ctx")))
    scored = computed(facts, reasons.alias("score_reasons"))
    scored = scored.withColumn("score", total_score(F.col("score_reasons"), settings.heuristic("layer3Cap")))
    scored = FX.apply_formulas(scored, settings)
    return scored.withColumn("classification", classify(F.col("score")))


def assess(messages: DataFrame, settings: Settings, rules: SuffixRules, contacts: DataFrame | None = None,
           account_domains: DataFrame | None = None, need_trusted: bool = False, rule_set: R.RuleSet = R.STANDARD) -> DataFrame:
    """Facts and assessment of every message, all fact columns kept."""
    if is_long(settings.trusted_servers):
        messages = with_trusted_ids(messages, listed(messages, tuple(settings.valid_trusted()), "value string, match_type string"))
    facts = with_facts(messages, settings, rules)
    return score_facts(with_lookups(facts, settings, contacts, account_domains), settings, need_trusted, rule_set)


ASSESSMENT_COLUMNS = ["msg_id", "account_id", "folder_id", "folder_name", "folder_type", "junk", "sent_at",
                      "received_at", "subject", "from_domain", "rfc_message_id", "score", "classification",
                      "score_reasons", "formula_diagnostics"]


def score_messages(messages: DataFrame, settings: Settings, rules: SuffixRules,
                   contacts: DataFrame | None = None, account_domains: DataFrame | None = None,
                   need_trusted: bool = False, rule_set: R.RuleSet = R.STANDARD) -> DataFrame:
    """``assessments(msg_id, ..., score, classification, score_reasons, formula_diagnostics)``."""
    full = assess(messages, settings, rules, contacts, account_domains, need_trusted, rule_set)
    return full.select(*[c for c in ASSESSMENT_COLUMNS if c in full.columns])


def reasons_table(assessments: DataFrame) -> DataFrame:
    """One row per reason of every message."""
    return (assessments.select("msg_id", "score", "classification", F.explode("score_reasons").alias("r"))
            .select("msg_id", "score", "classification", "r.*"))


def route(assessments: DataFrame, settings: Settings, review_folders: DataFrame) -> DataFrame:
    """Planned action of every message; nothing is moved.

    ``review_folders(account_id, review_folder_id)`` is looked up by account; few accounts may have most of the messages.
    """
    planned = F.when(F.col("classification") == "normal", F.lit("classified-normal"))
    if settings.move_high_risk_to_junk:
        planned = planned.when(F.col("classification") == "high-risk", "move-junk")
    if settings.move_to_review:
        planned = planned.when(F.col("review_folder_id").isNotNull(), "move-review") \
                         .otherwise("no-review-folder-configured")
    else:
        planned = planned.otherwise(F.concat(F.lit("classified-"), "classification"))
    folders = review_folders.select("account_id", "review_folder_id")
    return (lookup_join(assessments, folders, ["account_id"], F.col("msg_id"))
            .select(*assessments.columns, "review_folder_id").withColumn("action", planned))
