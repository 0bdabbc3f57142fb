"""Authentication results: parsing, trust and alignment with the From domain.

A message keeps its results as one array column, so every per-message aggregate is a
projection over that array. ``auth_results_table`` gives the same data as a long table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headrisk.functions.address import ASCII_BLANK, BLANK, dkim_domain, email_to_domain, filled, strip
from headrisk.functions.binding import let
from headrisk.functions.domains import dot_suffixes
from headrisk.settings import Settings

# a piece ends at a semicolon outside quotes
PIECE = r'(?:[^;"]++|"[^"]*+"?)++'
COMMENT = r"\([^()]*\)"
METHOD = r"^\s*([A-Za-z0-9_-]+)(?:\s*/\s*\d+)?\s*=\s*([A-Za-z0-9_-]+)"
PROPERTY = r'[A-Za-z][A-Za-z0-9._-]*\s*=\s*(?:"[^"]*"|[^\s;"]+)'


def _properties(text: Column) -> Column:
    """``key=value`` pairs as a map; the last of several equal keys counts."""
    def last_of_each(pairs: Column) -> Column:
        return let(F.transform(pairs, lambda p: p["k"]), lambda keys: F.map_from_entries(F.filter(
            pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["k"]))))

    def split_pair(found: Column) -> Column:
        key = F.substring_index(found, "=", 1)
        value = F.trim(F.substring(found, F.length(key) + 2, F.length(found)))
        return F.struct(F.lower(F.trim(key)).alias("k"), F.regexp_replace(value, '^"|"$', "").alias("v"))
    found = F.regexp_extract_all(text, F.lit(PROPERTY), F.lit(0))
    return F.when(text.contains("="), let(F.transform(found, split_pair), last_of_each)).otherwise(
        F.create_map().cast("map<string,string>"))


def _pieces(value: Column) -> Column:
    """A header value without comments, cut at semicolons outside quotes."""
    clean = F.when(value.contains("("), F.regexp_replace(F.regexp_replace(value, COMMENT, " "), COMMENT, " ")) \
        .otherwise(value)
    return F.when(clean.contains('"'), F.regexp_extract_all(clean, F.lit(PIECE), F.lit(0))) \
        .otherwise(F.split(clean, ";"))


def _server_of(pieces: Column) -> Column:
    return F.regexp_replace(strip(F.coalesce(F.get(pieces, F.lit(0)), F.lit(""))), r"\s+\d+$", "")


def parse_header_value(value: Column) -> Column:
    """One ``Authentication-Results`` value: server id and its results in order.

    A version number after the server id is dropped; any other trailing text stays part of the
    id, which keeps such a header untrusted.
    """
    def result(part: Column) -> Column:
        head = part["head"]
        name = F.substring_index(F.substring_index(head, "=", 1), "/", 1)  # a method version is dropped
        return F.struct(
            F.lower(F.btrim(name, F.lit(ASCII_BLANK))).alias("method"),
            F.lower(F.btrim(F.substring_index(head, "=", -1), F.lit(ASCII_BLANK))).alias("result"),
            _properties(F.substring(part["piece"], F.length(head) + 1, F.length(part["piece"]))).alias("properties"))

    def header_of(pieces: Column) -> Column:
        server = _server_of(pieces)
        parts = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces), F.lit(1))),
                            lambda p: F.struct(p.alias("piece"), F.regexp_extract(p, METHOD, 0).alias("head")))
        methods = F.filter(parts, lambda p: p["head"] != "")
        return F.struct(server.alias("authserv_id"), F.transform(methods, result).alias("results"))
    return let(_pieces(value), header_of)


def named_servers(headers: Column) -> Column:
    """Distinct server ids of a message's headers, lower case, sorted."""
    values = F.coalesce(F.try_element_at(headers, F.lit("authentication-results")), F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.transform(values, lambda v: F.lower(_server_of(_pieces(v))))))


def parse_auth_results(headers: Column, settings: Settings) -> Column:
    """All ``Authentication-Results`` headers of a message, with trust; untrusted ones are kept."""
    values = F.coalesce(F.try_element_at(headers, F.lit("authentication-results")),
                        F.array().cast("array<string>"))

    def domains(r: Column, i: Column) -> Column:
        prop = lambda name: F.try_element_at(r["properties"], F.lit(name))
        return F.struct(
            i.alias("res_pos"), r["method"], r["result"], r["properties"],
            email_to_domain(prop("smtp.mailfrom")).alias("mail_from_domain"),
            email_to_domain(prop("smtp.helo")).alias("helo_domain"),
            email_to_domain(prop("header.from")).alias("header_from_domain"),
            F.lower(dkim_domain(r["properties"])).alias("signing_domain"))
    return F.transform(F.transform(values, parse_header_value), lambda p, i: F.struct(
        i.alias("ar_pos"), p["authserv_id"].alias("authserv_id"),
        settings.header_trust(p["authserv_id"]).alias("trusted"),
        F.transform(p["results"], domains).alias("results")))


def server_in_header(value: Column) -> Column:
    """Raw id at the start of a header value, as the trust pre-scan sees it."""
    return filled(F.lower(F.regexp_extract(value, f"^([^;{BLANK}]*)", 1)))


def auth_results_table(facts: DataFrame) -> DataFrame:
    """Long table of results: one row per message, header and result."""
    return (facts.select("msg_id", F.explode("auth").alias("a"))
            .select("msg_id", "a.ar_pos", "a.authserv_id", "a.trusted", F.explode("a.results").alias("r"))
            .select("msg_id", "ar_pos", "authserv_id", "trusted", "r.res_pos", "r.method", "r.result",
                    "r.properties", "r.mail_from_domain", "r.header_from_domain", "r.signing_domain"))


def mark_trusted(servers: DataFrame, trusted: DataFrame, id_col: str = "authserv_id") -> DataFrame:
    """Trust flag for a table of server ids from a table of trust entries.

    Distinct ids are exploded to dot suffixes, which turns "ends with" into an equi-join.
    """
    rules = trusted.where(F.col("match_type").isin("exact", "domain")).select(
        F.lower("value").alias("suffix"), (F.col("match_type") == "domain").alias("below"))
    ids = servers.select(F.lower(F.col(id_col)).alias("id")).distinct()
    covered = (ids.select("id", F.explode(dot_suffixes(F.col("id"))).alias("suffix"))
               .join(rules, "suffix").where(F.col("below") | (F.col("suffix") == F.col("id")))
               .select(F.col("id").alias("_id"), F.lit(True).alias("_hit")).distinct())
    return (servers.join(covered, F.lower(F.col(id_col)) == F.col("_id"), "left")
            .withColumn("trusted", F.coalesce("_hit", F.lit(False))).drop("_id", "_hit"))


# ------------------------------------------------------------------ per-message aggregates
# The SQL below reads the columns from_parts, results (trusted results in order) of a facts row.

_PASS_SPF = "r.method = 'spf' AND r.result = 'pass'"
_PASS_DKIM = "r.method = 'dkim' AND r.result = 'pass'"
_FROM = "from_parts.registrable_domain"


def _any(condition: str) -> Column:
    return F.expr(f"coalesce(exists(results, r -> coalesce({condition}, false)), false)")


def _first(condition: str, value: str) -> Column:
    return F.expr(f"get(transform(filter(results, r -> coalesce({condition}, false)), r -> {value}), 0)")


def _distinct(condition: str, value: str) -> Column:
    return F.expr(f"array_distinct(transform(filter(results, r -> coalesce({condition}, false)), r -> {value}))")


def pass_alignment() -> Column:
    """Flags over trusted results; only passing results count as aligned.

    Without a registrable From domain every flag but ``any_trusted_auth_pass`` is off, and only
    there a HELO name stands in for a missing MAIL FROM.
    """
    has_from = F.expr(f"{_FROM} IS NOT NULL")

    def flag(condition: str) -> Column:
        return has_from & _any(condition)
    spf_aligned = flag(f"{_PASS_SPF} AND r.mail_from_reg = {_FROM}")
    dkim_aligned = flag(f"{_PASS_DKIM} AND r.signing_reg = {_FROM}")
    any_pass = F.when(has_from, _any(
        f"({_PASS_SPF} AND r.mail_from_reg IS NOT NULL) OR ({_PASS_DKIM} AND r.signing_reg IS NOT NULL)",
    )).otherwise(_any(
        f"({_PASS_SPF} AND IF(r.mail_from_domain IS NULL, r.helo_reg, r.mail_from_reg) IS NOT NULL)"
        f" OR ({_PASS_DKIM} AND r.signing_reg IS NOT NULL)"))
    return F.struct(
        spf_aligned.alias("spf_aligned"),
        dkim_aligned.alias("any_dkim_aligned"),
        (spf_aligned | dkim_aligned).alias("any_auth_aligned"),
        any_pass.alias("any_trusted_auth_pass"),
        F.when(has_from, _first(f"{_PASS_SPF} AND r.mail_from_reg IS NOT NULL", "r.mail_from_reg"))
        .alias("spf_mail_from_registrable_domain"),
        flag(_PASS_SPF).alias("any_trusted_spf_pass"),
        flag("r.method = 'dkim' AND r.result = 'fail'").alias("any_trusted_dkim_fail"),
        F.when(has_from, _distinct("r.method = 'dkim' AND r.result = 'fail' AND r.signing_domain IS NOT NULL",
                                   "r.signing_domain"))
        .otherwise(F.array().cast("array<string>")).alias("dkim_fail_domains"),
        flag("r.method = 'dmarc' AND r.result = 'fail'").alias("any_trusted_dmarc_fail"),
        flag("r.method = 'dmarc' AND r.result = 'pass'").alias("any_trusted_dmarc_pass"),
        flag("r.method = 'dmarc' AND r.result <> 'none'").alias("any_trusted_dmarc_non_none"),
        flag("r.method = 'dmarc' AND r.result = 'none'").alias("any_trusted_dmarc_none"),
        flag("r.method = 'spf' AND r.result = 'fail'").alias("any_trusted_spf_fail"),
        F.when(has_from, _first("r.method = 'spf' AND r.result = 'fail' AND r.mail_from_reg IS NOT NULL",
                                "r.mail_from_reg")).alias("spf_fail_mail_from_registrable_domain"),
    )


def alignment_metrics() -> Column:
    """First DMARC and SPF result, all DKIM results and whether any of them aligns."""
    dmarc = _first("r.method = 'dmarc'", "named_struct('result', r.result, 'header_from', r.header_from_domain,"
                   " 'header_from_registrable_domain', r.header_from_reg)")
    spf = _first("r.method = 'spf'", "named_struct('result', r.result, 'smtp_mail_from_domain', r.mail_from_domain,"
                 " 'smtp_mail_from_registrable_domain', r.mail_from_reg,"
                 " 'smtp_mail_from_subdomain_depth', r.mail_from_depth,"
                 f" 'aligned_with_from', coalesce(r.mail_from_reg = {_FROM}, false))")
    dkim = F.expr("transform(filter(results, r -> r.method = 'dkim'), r -> named_struct("
                  "'result', r.result, 'domain', r.signing_domain, 'registrable_domain', r.signing_reg,"
                  " 'subdomain_depth', r.signing_depth,"
                  f" 'aligned_with_from', coalesce(r.signing_reg = {_FROM}, false)))")
    def summed(found: Column) -> Column:
        spf_aligned = F.coalesce(found["spf"]["aligned_with_from"], F.lit(False))
        dkim_aligned = F.exists(found["dkim"], lambda d: d["aligned_with_from"])
        return F.struct(
            found["dmarc"].alias("dmarc"), found["spf"].alias("spf"), found["dkim"].alias("dkim"),
            F.struct(spf_aligned.alias("spf_aligned"), dkim_aligned.alias("any_dkim_aligned"),
                     (spf_aligned | dkim_aligned).alias("any_auth_aligned")).alias("summary"))
    return let(F.struct(dmarc.alias("dmarc"), spf.alias("spf"), dkim.alias("dkim")), summed)


def third_party_auth() -> Column:
    """DMARC none or absent, and every passing result vouches for somebody else."""
    authenticated = (f"({_PASS_SPF} AND r.mail_from_reg IS NOT NULL)"
                     f" OR ({_PASS_DKIM} AND r.signing_reg IS NOT NULL)")
    owner = "IF(r.method = 'spf', r.mail_from_reg, r.signing_reg)"
    return F.struct(
        (~_any("r.method = 'dmarc' AND r.result <> 'none'")).alias("dmarc_none_or_absent"),
        _any(authenticated).alias("any_pass"),
        _any(f"({authenticated}) AND {owner} = {_FROM}").alias("any_aligned"),
        _distinct(f"({authenticated}) AND {owner} <> {_FROM}", owner).alias("third_party_domains"),
        F.coalesce(_first("r.method = 'dmarc'", "r.result"), F.lit("absent")).alias("dmarc_result"),
    )


def foreign_authentication() -> Column:
    """First passing MAIL FROM and all passing signers of other registrable domains."""
    other = f"{_PASS_SPF} AND r.mail_from_reg <> {_FROM}"
    return F.struct(
        _first(other, "r.mail_from_domain").alias("mail_from_domain"),
        _first(other, "r.mail_from_reg").alias("mail_from_registrable_domain"),
        _distinct(f"{_PASS_DKIM} AND r.signing_reg <> {_FROM}", "r.signing_reg").alias("signers"))


def exact_alignment() -> Column:
    """Alignment on equal host names, used by the sender-consistency rules."""
    return F.struct(
        F.coalesce(
            _any(f"({_PASS_SPF} AND r.mail_from_domain = from_domain)"
                 f" OR ({_PASS_DKIM} AND r.signing_domain = from_domain)"), F.lit(False)).alias("aligned"),
        _any("r.method = 'spf' AND r.mail_from_domain <> from_domain").alias("mail_from_mismatch"),
        _any("r.method = 'dmarc' AND r.header_from_domain <> from_domain").alias("header_from_mismatch"),
        _any("r.method IN ('spf', 'dkim', 'dmarc') AND r.result = 'fail'").alias("any_fail"),
    )


def first_per_method(results: DataFrame) -> DataFrame:
    """First trusted result of each method of a message, from the long table."""
    order = F.struct("ar_pos", "res_pos")
    return (results.where("trusted").groupBy("msg_id", "method")
            .agg(F.min_by("result", order).alias("result"), F.count("*").alias("occurrences")))
