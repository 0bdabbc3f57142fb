"""Protection status of accounts, trusted-server setup and candidate servers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headrisk import constants as C
from headrisk.functions.address import email_domain, filled, strip
from headrisk.functions.domains import SuffixRules, build_domain_dim
from headrisk.operators.auth import mark_trusted
from headrisk.operators.history import newest_per_account
from headrisk.settings import Settings

HOSTNAME = r"(?i)^[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*$"


def is_hostname(value: Column) -> Column:
    return value.rlike(HOSTNAME)


def valid_trust_entries(entries: DataFrame) -> DataFrame:
    """Well-formed entries; an entry without a match type is an old plain one and means exact."""
    kind = F.coalesce("match_type", F.lit("exact"))
    return (entries.withColumn("match_type", kind)
            .where(F.col("value").isNotNull() & kind.isin("exact", "domain")))


def check_trust_entries(new: DataFrame, existing: DataFrame, rules: SuffixRules) -> DataFrame:
    """First problem of every proposed entry, null when it may be added."""
    value = strip(F.coalesce("value", F.lit("")))
    host = F.lower(value)
    hosts = new.select(host.alias("host"))
    regs = build_domain_dim(hosts, rules).select(F.col("host").alias("_host"), "registrable_domain")
    have = valid_trust_entries(existing).select(F.lower("value").alias("_have"), F.col("match_type").alias("_type"),
                                                F.lit(True).alias("_dup")).distinct()
    joined = (new.join(regs, host == F.col("_host"), "left")
              .join(have, (host == F.col("_have")) & (F.col("match_type") == F.col("_type")), "left"))
    domain = F.col("match_type") == "domain"
    return joined.withColumn("error", F.when(value == "", "empty").when(~is_hostname(value), "invalid_host")
                             .when(domain & F.col("registrable_domain").isNull(), "public_suffix")
                             .when(domain & (F.col("registrable_domain") != host), "not_registrable")
                             .when(F.col("_dup"), "duplicate")).drop("_host", "_have", "_type", "_dup")


def promotable_domains(trusted: DataFrame, rules: SuffixRules) -> DataFrame:
    """Registrable domain of every exact host that is not trusted as a domain yet."""
    hosts = trusted.where((F.col("match_type") == "exact") & is_hostname(F.col("value"))).select(
        "value", F.lower("value").alias("host"))
    regs = build_domain_dim(hosts, rules).where("registrable_domain IS NOT NULL").select("host", "registrable_domain")
    domains = trusted.where("match_type = 'domain'").select(F.col("value").alias("registrable_domain")).distinct()
    return hosts.join(regs, "host").join(domains, "registrable_domain", "left_anti").select("value", "registrable_domain")


def whitelist_entries(addresses: DataFrame, column: str = "address") -> DataFrame:
    value = F.lower(strip(F.col(column)))
    return addresses.select(value.alias("value"), F.lit("exact").alias("match_type")).where(F.col("value").contains("@"))


# ------------------------------------------------------------------ status

def account_mail(log: DataFrame, settings: Settings, hosts: DataFrame | None = None) -> DataFrame:
    """Newest twenty messages of every account by what vouched for them.

    ``hosts(account_id, host)`` adds how often that server is among the logged ones: a row for each account and host.
    """
    sample = newest_per_account(log)
    ids = F.filter(F.coalesce("authserv_ids", F.array().cast("array<string>")), lambda i: i != "")
    trusted_any = F.exists(ids, settings.is_trusted)
    cls = (F.when(F.size(ids) == 0, "none").when(trusted_any, "trusted")
           .when(F.col("authserv_ids_truncated") & F.lit(bool(settings.valid_trusted())), "unknown")
           .otherwise("untrusted"))
    rows = sample.withColumn("_cls", cls)
    seen = F.lit(False)
    possibly = F.lit(False)
    if hosts is not None:
        wanted = hosts.select(F.col("account_id").alias("_account"), filled(F.lower(strip(F.col("host")))).alias("_host")).distinct()
        rows = rows.join(wanted, F.col("account_id") == F.col("_account"), "left")
        seen = F.coalesce(F.exists("authserv_ids", lambda i: F.lower(i) == F.col("_host")), F.lit(False))
        possibly = F.col("_host").isNotNull() & ~seen & F.col("authserv_ids_truncated")
    count = lambda c: F.count_if(F.col("_cls") == c).alias(c)
    keys = ["account_id"] if hosts is None else ["account_id", F.col("_host").alias("host")]
    return rows.groupBy(*keys).agg(
        F.count("*").alias("total"), count("trusted"), count("untrusted"), count("unknown"), count("none"),
        F.count_if(seen).alias("host_seen"), F.count_if(possibly).alias("host_possibly_seen"))


def confirmed_hosts(account_setup: DataFrame, trusted: DataFrame) -> DataFrame:
    """Confirmed host of an account, only while the host is still trusted."""
    return (mark_trusted(account_setup.where("host <> ''"), valid_trust_entries(trusted), "host")
            .where("trusted").select("account_id", F.col("host").alias("confirmed_host")))


def protection_status(accounts: DataFrame, log: DataFrame, account_setup: DataFrame, trusted: DataFrame,
                      settings: Settings) -> DataFrame:
    """State of every account from its newest mail, its confirmation and the trust list."""
    mail = account_mail(log, settings)
    n_trusted = len(settings.valid_trusted())
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = (accounts.select("account_id").distinct()
              .join(mail, "account_id", "left").join(confirmed_hosts(account_setup, trusted), "account_id", "left")
              .select("account_id", "confirmed_host",
                      *[zero(c) for c in ("total", "trusted", "untrusted", "unknown", "none")]))
    configured = F.col("confirmed_host").isNotNull() | F.lit(n_trusted > 0)
    state = (F.when(F.col("trusted") > 0, "active").when(F.col("untrusted") > 0, "needs_confirmation")
             .when((F.col("total") >= C.NO_RESULTS_MIN_SAMPLE) & (F.col("none") == F.col("total")), "no_usable_ar")
             .when(configured, "awaiting_mail").otherwise("not_configured"))
    return (joined.withColumn("state", state).withColumn("trusted_count", F.lit(n_trusted))
            .withColumn("mismatch", (F.col("state") == "needs_confirmation") & configured))


def protection_summary(statuses: DataFrame) -> DataFrame:
    active = F.count_if(F.col("state") == "active")
    return statuses.agg(F.count("*").alias("total"), active.alias("active"), (F.count("*") - active).alias("inactive"),
                        ((F.count("*") > 0) & (active == F.count("*"))).alias("all_active"))


def trust_configured(trusted: DataFrame) -> DataFrame:
    n = F.count_if(F.coalesce("match_type", F.lit("exact")).isin("exact", "domain") & F.col("value").isNotNull())
    return trusted.agg((n > 0).alias("configured"), n.alias("count"))


# ------------------------------------------------------------------ setup

def setup_accounts(identities: DataFrame) -> DataFrame:
    """Accounts with at least one e-mail: their e-mails and distinct domains, in order.

    An account has a handful of identities, so its list stays small.
    """
    emails = identities.where(F.col("email").contains("@"))
    return (emails.groupBy("account_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "email"))).alias("e"))
        .select("account_id", F.transform("e", lambda x: x["email"]).alias("emails"))
        .withColumn("domains", F.array_compact(F.array_distinct(F.transform("emails", email_domain)))))


def load_identities(identities: DataFrame, rules: SuffixRules) -> DataFrame:
    """Registrable domains of every account's own addresses."""
    host = F.lower(F.substring_index(F.substring_index("email", "@", 2), "@", -1))
    owned = identities.where(F.col("email").contains("@")).select("account_id", host.alias("host")).distinct()
    dim = build_domain_dim(owned, rules).select("host", "registrable_domain")
    return (owned.join(dim, "host").where("registrable_domain IS NOT NULL").groupBy("account_id")
            .agg(F.sort_array(F.collect_set("registrable_domain")).alias("account_domains")))


def setup_suggestions(identities: DataFrame, mx: DataFrame | None = None) -> DataFrame:
    """Server names to suggest per account: common prefixes of its domains, then MX hosts."""
    domains = identities.select("account_id", "pos", email_domain(F.col("email")).alias("domain")) \
        .where("domain IS NOT NULL").groupBy("account_id", "domain").agg(F.min("pos").alias("pos"))
    guesses = domains.select("account_id", "domain", F.lit("heuristic").alias("source"),
                             F.posexplode(F.array(*[F.lit(p) for p in C.HOST_PREFIXES])).alias("k", "prefix"), "pos")
    found = guesses.select("account_id", F.concat("prefix", "domain").alias("host"), "source", "domain",
                           (F.col("pos") * len(C.HOST_PREFIXES) + F.col("k")).alias("o"), F.lit(0).alias("g"))
    if mx is not None:
        answers = domains.join(mx, "domain").select(
            "account_id", F.lower(F.trim("exchange")).alias("host"), F.lit("mx").alias("source"), "domain",
            F.col("priority").alias("o"), F.lit(1).alias("g")).where("host <> ''")
        found = found.unionByName(answers)
    return (found.groupBy("account_id", "host")
            .agg(F.min_by(F.struct("source", "domain"), F.struct("g", "o")).alias("s"))
            .select("account_id", "host", "s.source", "s.domain"))


def latest_setups(setups: DataFrame, n: int = C.SETUPS_MAX) -> DataFrame:
    """Well-formed confirmations, newest ``n``."""
    host = F.lower(strip(F.col("host")))
    ok = (F.length("account_id").between(1, 200) & (F.length(host) <= C.AUTHSERV_ID_MAX) & is_hostname(host))
    return (setups.where(ok).select("account_id", host.alias("host"),
                                    F.coalesce("confirmed_at", F.lit(0)).alias("confirmed_at"))
            .orderBy(F.desc("confirmed_at"), "account_id").limit(n))


def check_setup(choices: DataFrame, accounts: DataFrame, suggestions: DataFrame, settings: Settings,
                mail: DataFrame, rules: SuffixRules) -> DataFrame:
    """Checklist for a server chosen for an account: one row per item, in display order.

    ``choices(account_id, host)``; ``accounts`` from ``setup_accounts``; ``mail`` from
    ``account_mail`` with the same choices.
    """
    value = F.lower(strip(F.coalesce("host", F.lit(""))))
    base = (choices.select("account_id", value.alias("host"))
            .join(accounts.select("account_id", "domains"), "account_id", "left")
            .join(mail.withColumnRenamed("account_id", "_mail_account").withColumnRenamed("host", "_mail_host"),
                  (F.col("account_id") == F.col("_mail_account")) & filled(F.col("host")).eqNullSafe(F.col("_mail_host")), "left"))
    hinted = suggestions.select("account_id", "host", F.col("source").alias("hint")).dropDuplicates(["account_id", "host"])
    related_hosts = (accounts.select("account_id", F.explode("domains").alias("related"))
                     .unionByName(suggestions.where("source = 'mx'").select("account_id", F.col("host").alias("related"))))
    dim = build_domain_dim(choices.select(value.alias("host")).unionByName(
        related_hosts.select(F.col("related").alias("host"))), rules).select("host", "registrable_domain")
    related = (related_hosts.join(dim.withColumnRenamed("host", "related"), "related")
               .where("registrable_domain IS NOT NULL")
               .select("account_id", F.col("registrable_domain").alias("_reg"), F.lit(True).alias("_related")).distinct())
    row = (base.join(hinted, ["account_id", "host"], "left").join(dim, "host", "left").alias("b")
           .join(related.withColumnRenamed("account_id", "_acc"),
                 (F.col("account_id") == F.col("_acc")) & (F.col("registrable_domain") == F.col("_reg")), "left"))
    total, none = F.coalesce("total", F.lit(0)), F.coalesce("none", F.lit(0))
    text = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    item = lambda key, level, *params: F.struct(
        F.lit(key).alias("key"), level.alias("level") if isinstance(level, Column) else F.lit(level).alias("level"),
        F.array(*params).cast("array<string>").alias("params"))
    host = F.col("host")
    usable = (host != "") & is_hostname(host) & (F.length(host) <= C.AUTHSERV_ID_MAX)
    has_domains = F.coalesce(F.size("domains"), F.lit(0)) > 0
    items = F.array_compact(F.array(
        F.when(has_domains, item("account_domains", "ok", F.array_join("domains", ", ")))
        .otherwise(item("account_domains_none", "warn")),
        F.when(total == 0, item("mail_none_yet", "info")).otherwise(item(
            "mail_summary", F.when(F.col("trusted") > 0, "ok").otherwise("info"),
            text("total"), text("trusted"), text("untrusted"), text("none"))),
        F.when((total > 0) & (F.col("unknown") > 0), item("mail_unrecorded", "info", text("unknown"))),
        F.when((total > 0) & (none == total), item("mail_no_ar", "warn")),
        F.when((host != "") & ~usable, item("host_invalid", "warn", host)),
        F.when(usable & settings.is_trusted(host), item("host_already_trusted", "info", host)),
        F.when(usable, F.when(F.col("hint") == "mx", item("host_matches_mx", "ok", host))
               .when(F.col("hint").isNotNull(), item("host_matches_hint", "ok", host))
               .when(F.col("_related"), item("host_related_domain", "ok", F.col("registrable_domain")))
               .otherwise(item("host_unrelated", "warn", host))),
        F.when(usable & (total > 0) & (none < total),
               F.when(F.col("host_seen") > 0, item("host_seen", "info", text("host_seen"), text("total")))
               .when(F.col("host_possibly_seen") > 0, item("host_possibly_seen", "info", host, text("host_possibly_seen")))
               .otherwise(item("host_not_seen", "warn", host)))))
    return row.select("account_id", host, F.posexplode(items).alias("item_order", "i")).select(
        "account_id", "host", "item_order", "i.key", "i.level", F.array_join("i.params", "|").alias("params"))


def confirm_servers(requests: DataFrame, trusted: DataFrame, candidates: DataFrame) -> dict[str, DataFrame]:
    """Apply confirmation requests ``(account_id, host, confirmed, confirmed_at)``.

    Returns new trust entries, confirmations, the candidates that remain, and rejected requests.
    """
    host = F.lower(strip(F.coalesce("host", F.lit(""))))
    error = (F.when(~F.coalesce("confirmed", F.lit(False)), "confirmation_required")
             .when(~F.coalesce(F.length("account_id").between(1, 200), F.lit(False)), "missing_account")
             .when(host == "", "missing_host")
             .when((F.length(host) > C.AUTHSERV_ID_MAX) | ~is_hostname(host), "invalid_host"))
    checked = requests.withColumn("host", host).withColumn("error", error)
    good = checked.where("error IS NULL")
    added = (mark_trusted(good.select("host").distinct(), valid_trust_entries(trusted), "host")
             .where("NOT trusted").select(F.col("host").alias("value"), F.lit("exact").alias("match_type")))
    setups = good.groupBy("account_id").agg(
        F.max_by("host", F.struct("confirmed_at", "host")).alias("host"), F.max("confirmed_at").alias("confirmed_at"))
    remaining = candidates.join(good.select(F.col("host").alias("_host")).distinct(),
                                F.lower("authserv_id") == F.col("_host"), "left_anti")
    return {"trusted": valid_trust_entries(trusted).select("value", "match_type").unionByName(added),
            "added": added, "setups": setups, "candidates": remaining, "rejects": checked.where("error IS NOT NULL")}


# ------------------------------------------------------------------ candidates

def drop_trusted_candidates(candidates: DataFrame, trusted: DataFrame) -> DataFrame:
    return mark_trusted(candidates, valid_trust_entries(trusted)).where("NOT trusted").drop("trusted")


def prune_candidates(candidates: DataFrame, n: int = C.CANDIDATES_MAX) -> DataFrame:
    return candidates.orderBy(F.desc("last_seen"), "authserv_id").limit(n)


def candidates_by_domain(candidates: DataFrame, rules: SuffixRules) -> DataFrame:
    """Candidate servers grouped by registrable domain; the pruned list holds fifty at most."""
    dim = build_domain_dim(candidates.select(F.col("authserv_id").alias("host")), rules).select(
        F.col("host").alias("_host"), "registrable_domain")
    return (candidates.join(dim, F.lower("authserv_id") == F.col("_host")).where("registrable_domain IS NOT NULL")
            .groupBy("registrable_domain").agg(
                F.count("*").alias("servers"), F.sort_array(F.collect_set("authserv_id")).alias("authserv_ids"),
                F.max("last_seen").alias("last_seen")))


def promote_candidates(candidates: DataFrame, choices: DataFrame, trusted: DataFrame) -> dict[str, DataFrame]:
    """Trust chosen candidates exactly or by registrable domain and drop what that covers.

    ``candidates(authserv_id, registrable_domain, ...)``, ``choices(value, match_type)``.
    """
    exact = choices.where("match_type = 'exact'").select(F.col("value").alias("authserv_id")).distinct()
    domain = choices.where("match_type = 'domain'").select(F.col("value").alias("registrable_domain")).distinct()
    chosen = (exact.join(candidates, "authserv_id", "left_semi").select(F.col("authserv_id").alias("value"), F.lit("exact").alias("match_type"))
              .unionByName(domain.join(candidates, "registrable_domain", "left_semi")
                           .select(F.col("registrable_domain").alias("value"), F.lit("domain").alias("match_type"))))
    return {"trusted": trusted.select("value", "match_type").unionByName(chosen).dropDuplicates(["value", "match_type"]),
            "candidates": candidates.join(exact, "authserv_id", "left_anti")
            .join(domain, "registrable_domain", "left_anti")}
