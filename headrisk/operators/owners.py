"""Messages of many accounts scored in one run, each under its account's own settings.

Weights and options become one typed row per account, joined once per message; trust lists, whitelists
and sender rules go to the messages of their account where they are short, else they stay tables that are
joined on equal keys (``operators.lookups``). The rules are
those of ``operators.rules``: they ask a ``Settings`` for a weight and get a column instead of a number.
Formulas are still those of the run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headrisk import constants as C
from headrisk.functions.domains import SuffixRules
from headrisk.operators.facts import with_facts
from headrisk.operators.lookups import lookup_join, with_sender_hits, with_trusted_ids, with_whitelist_hit
from headrisk.operators.scoring import score_facts, with_lookups
from headrisk.operators.settings import GROUPS, _flat, merge_weights, migrate_weights
from headrisk.settings import Settings

OPTIONS = {"whitelist_score": ("double", C.WHITELIST_SCORE), "address_book_score": ("double", C.ADDRESS_BOOK_SCORE),
           "address_book_enabled": ("boolean", False), "move_to_review": ("boolean", True),
           "move_high_risk_to_junk": ("boolean", False), "alert_enabled": ("boolean", False),
           "alert_max_score": ("double", C.ALERT_MAX_SCORE), "alert_delay_ms": ("int", C.ALERT_DELAY_MS),
           "alert_interval_ms": ("int", C.ALERT_INTERVAL_MS)}
FIXED = ("identity", "heuristic", "composite")


@dataclass(frozen=True)
class OwnerTables:
    """Settings of all accounts: ``parameters`` (see ``owner_parameters``), ``trusted(account_id, value,
    match_type)``, ``whitelist(account_id, pos, value, match_type)`` and ``sender_rules(account_id, pos,
    domain, match_type, score)``. An account without rows has the defaults and empty lists."""

    parameters: DataFrame
    trusted: DataFrame
    whitelist: DataFrame
    sender_rules: DataFrame


@dataclass(frozen=True)
class OwnerSettings(Settings):
    """Settings whose values are columns of the message's row."""

    def identity(self, key: str) -> Column:
        return F.col(f"params.identity.{key}")

    def heuristic(self, key: str) -> Column:
        return F.col(f"params.heuristic.{key}")

    def composite(self, key: str) -> Column:
        return F.col(f"params.composite.{key}")

    def composites(self) -> dict:
        return {k: self.composite(k) for k in C.COMPOSITE_SCORES}

    def auth_weights(self) -> Column:
        return F.col("params.auth")

    def header_trust(self, server: Column) -> Column:
        return F.coalesce(F.array_contains(F.col("trusted_ids"), F.lower(server)), F.lit(False))

    def whitelist_hit(self, sender: Column) -> Column:
        return F.col("whitelist_hit")

    def sender_hits(self, domain: Column) -> Column:
        return F.col("sender_hits")


def owner_settings() -> OwnerSettings:
    return OwnerSettings(address_book_enabled=True, **{k: F.col(f"params.options.{k}") for k in OPTIONS if k != "address_book_enabled"})


def default_parameters() -> Column:
    """The parameters of an account that has stored nothing."""
    groups = [F.struct(*[F.lit(w).alias(k) for k, w in _flat(GROUPS[g]).items()]).alias(g) for g in FIXED]
    auth = F.create_map(*[F.lit(v) for pair in _flat(C.AUTH_SCORES).items() for v in pair]).alias("auth")
    return F.struct(*groups, auth, F.struct(*[F.lit(v).cast(t).alias(k) for k, (t, v) in OPTIONS.items()]).alias("options"))


def owner_parameters(weights: DataFrame, versions: DataFrame | None = None, options: DataFrame | None = None) -> DataFrame:
    """``(account_id, params)``: one typed row per account.

    ``weights(account_id, group, key, weight)`` as stored; groups that equal earlier defaults are
    brought up to date where ``versions(account_id, version)`` is given. ``options(account_id, ...)``
    has any of ``OPTIONS``; nulls mean the default.
    """
    stored = weights.withColumnRenamed("account_id", "tenant")
    if versions is not None:
        stored = migrate_weights(stored, versions.withColumnRenamed("account_id", "tenant")).drop("migrated")
    merged = merge_weights(stored)
    of = lambda g, k: F.max(F.when((F.col("group") == g) & (F.col("key") == k), F.col("weight")))
    fixed = {g: list(_flat(GROUPS[g])) for g in FIXED}
    flat = merged.groupBy("tenant").agg(
        *[of(g, k).alias(f"{g}_{k}") for g, keys in fixed.items() for k in keys],
        # as many entries as an account stores results
        F.map_from_entries(F.collect_list(F.when(F.col("group") == "auth", F.struct("key", "weight")))).alias("auth"))
    rows = flat.select(F.col("tenant").alias("account_id"), "auth",
                       *[F.struct(*[F.col(f"{g}_{k}").alias(k) for k in keys]).alias(g) for g, keys in fixed.items()])
    given = options if options is not None else rows.select("account_id").limit(0)
    chosen = F.struct(*[F.coalesce(F.col(k).cast(t) if k in given.columns else F.lit(None).cast(t), F.lit(v).cast(t)).alias(k)
                        for k, (t, v) in OPTIONS.items()]).alias("options")
    kept = given.select("account_id", *[c for c in given.columns if c in OPTIONS])
    both = rows.join(kept, "account_id", "full_outer")
    defaults = default_parameters()
    return both.select("account_id", F.struct(
        *[F.coalesce(F.col(g), defaults[g]).alias(g) for g in FIXED], F.coalesce("auth", defaults["auth"]).alias("auth"), chosen).alias("params"))


def with_parameters(messages: DataFrame, parameters: DataFrame) -> DataFrame:
    """Add ``params``, the parameters of the message's account."""
    joined = lookup_join(messages, parameters, ["account_id"], F.col("msg_id"))
    return joined.withColumn("params", F.coalesce("params", default_parameters()))


def assess_by_owner(messages: DataFrame, owners: OwnerTables, rules: SuffixRules, contacts: DataFrame | None = None,
                    account_domains: DataFrame | None = None, need_trusted: bool = False) -> DataFrame:
    """``scoring.assess`` under the settings of each message's account."""
    settings = owner_settings()
    own = with_trusted_ids(with_parameters(messages, owners.parameters), owners.trusted)
    facts = with_lookups(with_facts(own, settings, rules), settings, contacts, account_domains)
    facts = facts.withColumn("in_address_book", F.col("in_address_book") & F.col("params.options.address_book_enabled"))
    facts = with_sender_hits(with_whitelist_hit(facts, owners.whitelist), owners.sender_rules)
    return score_facts(facts, settings, need_trusted)
