"""Named queries over the driver's tables, each with the SQL that DuckDB checks it against."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headrisk import constants as C
from headrisk.functions import address as A
from headrisk.functions import names as N
from headrisk.functions import text as T
from headrisk.functions.domains import COMMON_RULES, SUFFIX_CONF, SuffixRules, build_domain_dim, load_suffix_rules
from headrisk.functions.jaro import jaro_winkler_similarity
from headrisk.operators import alerts as AL
from headrisk.operators import auth as AU
from headrisk.operators import facts as FA
from headrisk.operators import history as H
from headrisk.operators import protection as P
from headrisk.operators import report as RP
from headrisk.operators import rules as R
from headrisk.operators import scoring as S
from headrisk.operators import settings as ST
from headrisk.plans import derived_mail as M
from headrisk.plans import oracle as O
from headrisk.sources import mail as SRC
from headrisk.streaming.jobs import stream_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


# ------------------------------------------------------------------ shared inputs
# plans (not data) are kept per application, because building the rule expressions takes a while

_PLANS: dict = {}


def plan(name: str, build):
    def get(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf, name)
        if key not in _PLANS:
            _PLANS[key] = build(spark, sf)
        return _PLANS[key]
    return get


def rules(spark):
    """The session's list; without one, the few registries that the test mail needs, named here and not chosen by what a machine holds."""
    return load_suffix_rules(spark) if spark.conf.get(SUFFIX_CONF, None) else SuffixRules.from_rows(COMMON_RULES)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


messages = plan("messages", M.derived_messages)
facts = plan("facts", lambda s, sf: FA.with_facts(messages(s, sf), M.derived_settings(), rules(s)))


def facts_of(*groups: str):
    """Facts of some groups only."""
    return plan("facts of " + " ".join(groups), lambda s, sf: FA.with_facts(messages(s, sf), M.derived_settings(), rules(s), groups))


alignment_only, header_only, message_id_only, name_only = (facts_of(g) for g in ("alignment", "headers", "message_id", "brands"))
looked_up_plain = plan("looked_up_plain", lambda s, sf: S.with_lookups(
    facts_of("headers", "message_id", "lexical", "names")(s, sf), M.derived_settings(), M.contacts(s), M.account_domains(s, sf)))
looked_up = plan("looked_up", lambda s, sf: S.with_lookups(
    facts(s, sf), M.derived_settings(), M.contacts(s), M.account_domains(s, sf)))
assessed = plan("assessed", lambda s, sf: S.score_facts(looked_up(s, sf), M.derived_settings()))
log = plan("log", lambda s, sf: H.log_entries(assessed(s, sf), F.col("received_at"), M.derived_settings()))
# what a log row knows before any score
log_heads = plan("log_heads", lambda s, sf: H.log_heads(messages(s, sf), F.col("received_at"), M.derived_settings()))
# the log keeps a row per message; a mailbox row repeats where the client holds a copy
mailbox = plan("mailbox", lambda s, sf: messages(s, sf).select("*", A.header(F.col("headers"), "message-id").alias("_mid")).select(
    "msg_id", A.normalise_message_id(F.col("_mid")).alias("header_message_id"),
    "account_id", "folder_id", "folder_name", "folder_type", "junk"))


def doc_addresses(spark, sf) -> DataFrame:
    """Addresses that occur in documents, one row per document and address."""
    found = F.regexp_extract_all("text", F.lit(DOC_ADDRESS), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(found)).alias("address"))


DOC_ADDRESS = r"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]*[A-Za-z0-9]"
DOC_ADDRESS_SQL = ("docs AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, "
                   "'[A-Za-z0-9._+-]+@[A-Za-z0-9.-]*[A-Za-z0-9]')) AS address FROM documents)")
HOST_SQL = "hosts AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages)"


def page_hosts(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"))


# ------------------------------------------------------------------ assessment

@query("classification_counts", O.over(
    "SELECT count(*) FILTER (classification = 'normal') AS normal, count(*) FILTER (classification = 'review') AS review, "
    "count(*) FILTER (classification = 'high-risk') AS high_risk FROM assessed"))
def classification_counts(spark, sf):
    return RP.classification_counts(assessed(spark, sf))


@query("auth_only_classes", O.over(
    "SELECT CASE WHEN s >= 100 THEN 'high-risk' WHEN s >= 50 THEN 'review' ELSE 'normal' END AS classification, "
    "count(*) AS n FROM (SELECT m.msg_id, coalesce(sum(delta), 0) AS s FROM mail m LEFT JOIN auth_reasons r USING (msg_id) "
    "GROUP BY m.msg_id) GROUP BY 1"))
def auth_only_classes(spark, sf):
    m = messages(spark, sf).select(AU.parse_auth_results(F.col("headers"), M.derived_settings()).alias("auth"))
    scored = m.select(S.total_score(R.auth_reasons(M.derived_settings()), 0).alias("score"))
    return scored.groupBy(S.classify(F.col("score")).alias("classification")).agg(F.count("*").alias("n"))


@query("score_messages", O.over(
    "SELECT a.msg_id, score, classification, coalesce(string_agg(key, ' ' ORDER BY ord), '') AS reason_keys "
    "FROM assessed a LEFT JOIN reasons USING (msg_id) GROUP BY a.msg_id, score, classification"))
def score_messages(spark, sf):
    return assessed(spark, sf).select("msg_id", "score", "classification", F.array_join(
        F.transform("score_reasons", lambda r: r["key"]), " ").alias("reason_keys"))


@query("reason_rows", O.over(
    "SELECT msg_id, row_number() OVER (PARTITION BY msg_id ORDER BY ord) - 1 AS seq, layer, key, delta FROM reasons"))
def reason_rows(spark, sf):
    return S.reasons_table(assessed(spark, sf)).select("msg_id", F.col("seq").cast("bigint").alias("seq"), "layer", "key", "delta")


@query("layer_totals", O.over("SELECT layer, count(*) AS reasons, sum(delta) AS total FROM reasons GROUP BY layer"))
def layer_totals(spark, sf):
    return S.reasons_table(assessed(spark, sf)).groupBy("layer").agg(
        F.count("*").alias("reasons"), F.sum("delta").alias("total"))


# ------------------------------------------------------------------ one query per rule

def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


@lru_cache(maxsize=4)
def _rule_columns(_application: str):
    settings = M.derived_settings()
    groups = (("identity", R.identity_rules(settings)), ("heuristic", R.heuristic_rules(settings)),
              ("composite", R.composite_rules(settings) + R.consistency_rules(settings)))
    keys = {g: [k for k in O.RULE_SQL if k.startswith(g + ".")] for g, _c in groups}
    return {k: c for g, cols in groups for k, c in zip(keys[g], cols)}


def _rule_query(key: str):
    def run(spark, sf):
        column = _rule_columns(spark.sparkContext.applicationId)[key]
        rows = looked_up if key == "composite.brandDivergencePhishing" else looked_up_plain
        return (rows(spark, sf).select("msg_id", column.alias("r")).where("r IS NOT NULL")
                .select("msg_id", "r.layer", "r.key", "r.delta"))
    return run


for _key in O.RULE_SQL:
    if _key.split(".")[0] in ("identity", "heuristic", "composite"):
        query("rule_" + _snake(_key.split(".")[1]),
              O.over(f"SELECT msg_id, layer, key, delta FROM ({O.rule_select(_key)})", O.MAIL, O.FACTS))(_rule_query(_key))


def _user_rule_query(key: str):
    def run(spark, sf):
        f = looked_up_plain(spark, sf).select("msg_id", F.explode(R.user_rules(M.derived_settings())).alias("r"))
        return f.where(F.col("r.key") == key).select("msg_id", "r.layer", "r.key", "r.delta")
    return run


for _key, _name in (("whitelist.manual", "rule_manual_whitelist"), ("whitelist.addressBook", "rule_address_book"),
                    ("sender.rule", "rule_sender_domain")):
    query(_name, O.over(f"SELECT msg_id, layer, key, delta FROM ({O.rule_select(_key)})", O.MAIL, O.FACTS))(_user_rule_query(_key))


@query("rule_auth_results", O.over("SELECT msg_id, key, delta, count(*) AS n FROM auth_reasons GROUP BY ALL"))
def rule_auth_results(spark, sf):
    m = messages(spark, sf).select("msg_id", AU.parse_auth_results(F.col("headers"), M.derived_settings()).alias("auth"))
    return (m.select("msg_id", F.explode(R.auth_reasons(M.derived_settings())).alias("r"))
            .groupBy("msg_id", "r.key", "r.delta").agg(F.count("*").alias("n")))


@query("capped_heuristics", O.over(
    "SELECT msg_id, sum(delta) AS uncapped, least(sum(delta), 25.0) AS capped, least(sum(delta), 25.0) > 0 AS lexical_penalty "
    "FROM reasons WHERE layer = 'L3' GROUP BY msg_id"))
def capped_heuristics(spark, sf):
    s = M.derived_settings()
    r = F.array_compact(F.array(*R.heuristic_rules(s)))
    f = looked_up_plain(spark, sf).select("msg_id", r.alias("r"), R.lexical_penalty(s).alias("lexical_penalty")).where(F.size("r") > 0)
    total = F.aggregate("r", F.lit(0.0), lambda t, x: t + x["delta"])
    return f.select("msg_id", total.alias("uncapped"), F.least(total, F.lit(25.0)).alias("capped"), "lexical_penalty")


# ------------------------------------------------------------------ authentication facts

@query("parse_auth_results", O.over(
    "SELECT msg_id, ar_pos, authserv_id, trusted, res_pos, method, result, mail_from_domain, signing_domain, "
    "header_from_domain FROM allres", O.MAIL))
def parse_auth_results(spark, sf):
    m = messages(spark, sf).select("msg_id", AU.parse_auth_results(F.col("headers"), M.derived_settings()).alias("auth"))
    t = AU.auth_results_table(m).drop("properties")
    return t.select("msg_id", F.col("ar_pos").cast("bigint").alias("ar_pos"), "authserv_id", "trusted",
                    F.col("res_pos").cast("bigint").alias("res_pos"), "method", "result", "mail_from_domain",
                    "signing_domain", "header_from_domain")


@query("mark_trusted", O.over("SELECT DISTINCT authserv_id, trusted FROM heads", O.MAIL))
def mark_trusted(spark, sf):
    m = messages(spark, sf).select("msg_id", AU.parse_auth_results(F.col("headers"), M.derived_settings()).alias("auth"))
    ids = m.select(F.explode("auth.authserv_id").alias("authserv_id")).distinct()
    trusted = spark.createDataFrame(list(M.derived_settings().trusted_servers), "value string, match_type string")
    return AU.mark_trusted(ids, trusted)


@query("first_per_method", O.over(
    "SELECT msg_id, method, arg_min(result, ar_pos * 1000 + res_pos) AS result, count(*) AS occurrences FROM res "
    "GROUP BY msg_id, method", O.MAIL))
def first_per_method(spark, sf):
    m = messages(spark, sf).select("msg_id", AU.parse_auth_results(F.col("headers"), M.derived_settings()).alias("auth"))
    return AU.first_per_method(AU.auth_results_table(m))


@query("pass_alignment", O.over(
    "SELECT f.msg_id, f.spf_aligned, f.dkim_aligned AS any_dkim_aligned, f.aligned AS any_auth_aligned, "
    "f.any_pass AS any_trusted_auth_pass, f.spf_reg AS spf_mail_from_registrable_domain, f.spf_pass AS any_trusted_spf_pass, "
    "f.dkim_fail AS any_trusted_dkim_fail, coalesce(d.fails, '') AS dkim_fail_domains, f.dmarc_fail AS any_trusted_dmarc_fail, "
    "f.dmarc_pass AS any_trusted_dmarc_pass, f.dmarc_non_none AS any_trusted_dmarc_non_none, "
    "f.dmarc_none AS any_trusted_dmarc_none, f.spf_fail AS any_trusted_spf_fail, "
    "f.spf_fail_reg AS spf_fail_mail_from_registrable_domain FROM facts f LEFT JOIN (SELECT msg_id, "
    "string_agg(signing_domain, ',' ORDER BY ar_pos, res_pos) AS fails FROM res WHERE method = 'dkim' AND result = 'fail' "
    "AND from_reg IS NOT NULL GROUP BY msg_id) d USING (msg_id)", O.MAIL, O.FACTS))
def pass_alignment(spark, sf):
    a = alignment_only(spark, sf).select("msg_id", "alignment.*")
    return a.withColumn("dkim_fail_domains", F.array_join("dkim_fail_domains", ","))


@query("alignment_metrics", O.over(
    "SELECT m.msg_id, d.result AS dmarc, d.header_from_domain AS header_from, s.result AS spf, "
    "s.mail_from_domain AS smtp_mail_from, coalesce(k.n, 0) AS dkim_results, coalesce(s.mail_from_reg = s.from_reg, false) "
    "AS spf_aligned, coalesce(k.aligned, false) AS any_dkim_aligned, coalesce(s.mail_from_reg = s.from_reg, false) OR "
    "coalesce(k.aligned, false) AS any_auth_aligned FROM mail m "
    "LEFT JOIN (SELECT * FROM res WHERE method = 'dmarc' QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY ar_pos, res_pos) = 1) d USING (msg_id) "
    "LEFT JOIN (SELECT * FROM res WHERE method = 'spf' QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY ar_pos, res_pos) = 1) s USING (msg_id) "
    "LEFT JOIN (SELECT msg_id, count(*) AS n, bool_or(coalesce(signing_reg = from_reg, false)) AS aligned FROM res WHERE method = 'dkim' GROUP BY msg_id) k USING (msg_id)",
    O.MAIL))
def alignment_metrics(spark, sf):
    a = alignment_only(spark, sf).select("msg_id", AU.alignment_metrics().alias("a"))
    return a.select("msg_id", F.col("a.dmarc.result").alias("dmarc"), F.col("a.dmarc.header_from").alias("header_from"),
                    F.col("a.spf.result").alias("spf"), F.col("a.spf.smtp_mail_from_domain").alias("smtp_mail_from"),
                    F.size("a.dkim").cast("bigint").alias("dkim_results"), "a.summary.*")


@query("third_party_auth", O.over(
    "SELECT f.msg_id, NOT dmarc_non_none_x AS dmarc_none_or_absent, any_pass, aligned AS any_aligned, "
    "coalesce(tp.doms, '') AS third_party_domains, coalesce(d.result, 'absent') AS dmarc_result FROM (SELECT ff.*, "
    "coalesce(x.nn, false) AS dmarc_non_none_x FROM facts ff LEFT JOIN (SELECT msg_id, bool_or(method = 'dmarc' AND result <> 'none') AS nn "
    "FROM res GROUP BY msg_id) x USING (msg_id)) f LEFT JOIN (SELECT msg_id, string_agg(dom, ',' ORDER BY o) AS doms FROM ("
    "SELECT msg_id, CASE WHEN method = 'spf' THEN mail_from_reg ELSE signing_reg END AS dom, min(ar_pos * 1000 + res_pos) AS o FROM res "
    "WHERE result = 'pass' AND method IN ('spf', 'dkim') AND CASE WHEN method = 'spf' THEN mail_from_reg ELSE signing_reg END <> from_reg "
    "GROUP BY 1, 2) GROUP BY msg_id) tp USING (msg_id) LEFT JOIN (SELECT * FROM res WHERE method = 'dmarc' "
    "QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY ar_pos, res_pos) = 1) d USING (msg_id)", O.MAIL, O.FACTS))
def third_party_auth(spark, sf):
    return alignment_only(spark, sf).select("msg_id", "third_party.*").withColumn(
        "third_party_domains", F.array_join("third_party_domains", ","))


# ------------------------------------------------------------------ message facts

@query("message_identity", O.over(
    "SELECT msg_id, mid_h AS rfc_message_id, account_id AS initial_account_id, folder_id AS initial_folder_id, "
    "folder_name AS initial_folder_name, subject, from_h AS from_header FROM mail", O.MAIL))
def message_identity(spark, sf):
    return FA.message_identity(messages(spark, sf)).select(
        "msg_id", "rfc_message_id", "initial_account_id", "initial_folder_id", "initial_folder_name", "subject",
        F.col("from").alias("from_header"))


@query("parse_from", O.over(
    "SELECT msg_id, from_addr AS mailbox_address, CASE WHEN from_addr IS NULL THEN 'invalid' ELSE 'ok' END AS parse_status, "
    "from_domain, nullif(from_local, '') AS from_local FROM ident", O.MAIL))
def parse_from(spark, sf):
    h = messages(spark, sf).select("msg_id", A.header(F.col("headers"), "from").alias("f"))
    own = h.select("msg_id", "f", A.mailbox_address(F.col("f")).alias("a"))
    sender = FA.sender_columns(F.col("a"))
    return own.select("msg_id", A.parse_from(F.col("f"), F.col("a")).alias("p"), sender["from_domain"].alias("from_domain"),
                      sender["from_local"].alias("from_local")).select(
        "msg_id", "p.mailbox_address", "p.parse_status", "from_domain", "from_local")


@query("message_id_domain", O.over("SELECT msg_id, mid_domain_x AS message_id_domain FROM ident", O.MAIL))
def message_id_domain(spark, sf):
    return messages(spark, sf).select("msg_id", A.message_id_domain(A.header(F.col("headers"), "message-id")).alias("message_id_domain"))


@query("header_facts", O.over(
    "SELECT msg_id, sender_domain, sender_reg AS sender_registrable_domain, sender_reg = from_reg AS sender_matches, "
    "reply_domain AS reply_to_domain, reply_reg = from_reg AS reply_to_matches, return_domain AS return_path_domain, "
    "return_reg AS return_path_registrable_domain, return_reg = from_reg AS return_path_matches, list_id_h AS list_id, "
    "list_unsub_h AS list_unsubscribe, listed AS has_list_headers FROM facts", O.MAIL, O.FACTS))
def header_facts(spark, sf):
    h = "header_facts."
    return header_only(spark, sf).select(
        "msg_id", h + "sender_domain", h + "sender_registrable_domain",
        F.col(h + "sender_domain_matches_from_domain").alias("sender_matches"), h + "reply_to_domain",
        F.col(h + "reply_to_domain_matches_from_domain").alias("reply_to_matches"), h + "return_path_domain",
        h + "return_path_registrable_domain", F.col(h + "return_path_domain_matches_from_domain").alias("return_path_matches"),
        h + "list_id", h + "list_unsubscribe", h + "has_list_headers")


@query("message_id_facts", O.over(
    "SELECT msg_id, mid_domain_x AS message_id_domain, mid_reg AS message_id_registrable_domain, "
    f"{O.depth('mid_domain_x')} AS message_id_subdomain_depth, mid_reg = from_reg AS message_id_domain_matches_from_domain, "
    "coalesce(mid_reg <> from_reg, false) AS message_id_from_domain_mismatch, "
    "coalesce(mid_reg <> from_reg AND NOT aligned, false) AS message_id_mismatch_with_unaligned_auth FROM facts", O.MAIL, O.FACTS))
def message_id_facts(spark, sf):
    m = message_id_only(spark, sf).select("msg_id", "message_id_facts.*").drop("message_id_is_icann")
    return m.withColumn("message_id_subdomain_depth", F.col("message_id_subdomain_depth").cast("bigint"))


_GRAMS = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substring({0}, i, 3)))"
_CORE_NORM = "lower(regexp_replace(substring(from_reg, 1, length(from_reg) - length(from_suffix) - 1), '[^a-z0-9]', '', 'g'))"
_REASON = (f"CASE WHEN display_name IS NULL THEN 'missing_display_name' WHEN from_reg IS NULL THEN 'missing_domain_core' "
           f"WHEN length({_CORE_NORM}) < 3 OR length(name_norm) < 3 THEN 'short_normalized' END")


@query("display_name_facts", O.over(
    f"SELECT msg_id, display_name, name_norm, reason, CASE WHEN reason IS NULL THEN {O.round3('len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb)))::DOUBLE')} END AS similarity, "
    "CASE WHEN display_name IS NOT NULL THEN NOT regexp_matches(display_name, '^[A-Z][a-z''-]+ [A-Z][a-z''-]+$') END AS brand_like, "
    "brand_domain, CASE WHEN brand_domain IS NOT NULL THEN from_reg <> brand_domain END AS brand_mismatch, brand_rank, "
    "coalesce(regexp_matches(display_name, '^[^@ ]+@[^@. ]+[.][^@ ]+$'), false) AS looks_like_email, "
    "CASE WHEN regexp_matches(display_name, '^[^@ ]+@[^@. ]+[.][^@ ]+$') THEN lower(display_name) = from_addr END AS email_matches "
    f"FROM (SELECT *, {_REASON} AS reason, {_GRAMS.format('name_norm')} AS ga, {_GRAMS.format(_CORE_NORM)} AS gb FROM facts)",
    O.MAIL, O.FACTS))
def display_name_facts(spark, sf):
    n = "name_facts."
    return name_only(spark, sf).select(
        "msg_id", F.col(n + "display_name_raw").alias("display_name"), F.col(n + "display_name_normalized").alias("name_norm"),
        F.col(n + "display_name_domain_metric_not_applicable_reason").alias("reason"),
        F.col(n + "display_name_domain_similarity").alias("similarity"),
        F.col(n + "display_name_brand_like_shape").alias("brand_like"), F.col(n + "inferred_brand_domain").alias("brand_domain"),
        F.col(n + "brand_domain_mismatch").alias("brand_mismatch"), F.col(n + "brand_inference_candidate_rank").alias("brand_rank"),
        F.col(n + "display_name_looks_like_email").alias("looks_like_email"),
        F.col(n + "display_name_email_matches_from_address").alias("email_matches"))


@query("infer_brand", O.over("SELECT display_name, brand_domain, brand_rank, brand_score FROM brand", O.MAIL, O.FACTS))
def infer_brand(spark, sf):
    n = "name_facts."
    return (name_only(spark, sf).select(
        F.col(n + "display_name_raw").alias("display_name"), F.col(n + "inferred_brand_domain").alias("brand_domain"),
        F.col(n + "brand_inference_candidate_rank").alias("brand_rank"), F.col(n + "inferred_brand_score").alias("brand_score"))
        .where("brand_domain IS NOT NULL").distinct())


@query("exact_alignment", O.over("SELECT msg_id, exact AS aligned, x_mf AS mail_from_mismatch, x_hf AS header_from_mismatch, any_fail FROM facts", O.MAIL, O.FACTS))
def exact_alignment(spark, sf):
    return alignment_only(spark, sf).select("msg_id", "exact.*")


# ------------------------------------------------------------------ hosts, labels, addresses

@query("domain_dim", O.over(
    f"SELECT host, {O.reg('host')} AS registrable_domain, {O.suffix('host')} AS public_suffix, "
    f"CAST({O.depth('host')} AS INTEGER) AS subdomain_depth FROM hosts", HOST_SQL))
def domain_dim(spark, sf):
    return build_domain_dim(page_hosts(spark, sf), rules(spark)).select(
        "host", "registrable_domain", "public_suffix", "subdomain_depth")


@query("site_traffic", O.over(
    f"SELECT {O.reg('host')} AS registrable_domain, count(*) AS pages, count(DISTINCT host) AS hosts FROM (SELECT "
    "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages) GROUP BY 1", HOST_SQL))
def site_traffic(spark, sf):
    hits = page_hosts(spark, sf).groupBy(F.lower("host").alias("host")).agg(F.count("*").alias("pages"))
    dim = build_domain_dim(hosts=hits, rules=rules(spark)).select("host", "registrable_domain")
    return hits.join(dim, "host").groupBy("registrable_domain").agg(
        F.sum("pages").alias("pages"), F.count("*").alias("hosts"))


_LABELS = "labels AS (SELECT DISTINCT unnest(string_split(host, '.')) AS label FROM hosts)"


def page_labels(spark, sf):
    return page_hosts(spark, sf).select(F.explode(F.split("host", r"\.")).alias("label")).distinct()


@query("label_randomness", O.over(
    f"SELECT label, {O.round3(O.entropy('label'))} AS entropy, {O.round3(O.vowel_ratio('label'))} AS vowel_ratio, "
    f"{O.run('label')} AS max_consonant_run, {O.random_label('label')} AS is_random FROM labels", HOST_SQL, _LABELS))
def label_randomness(spark, sf):
    x = F.col("label")
    return page_labels(spark, sf).select(
        "label", T.round3(T.entropy(x)).alias("entropy"), T.round3(T.vowel_ratio(x)).alias("vowel_ratio"),
        T.max_consonant_run(x).cast("bigint").alias("max_consonant_run"), T.is_random_label(x).alias("is_random"))


_LOCALS = ", locals AS (SELECT DISTINCT split_part(address, '@', 1) AS local FROM docs)"


@query("local_part_randomness", O.over(f"SELECT local, {O.random_local('local')} AS is_random FROM locals", DOC_ADDRESS_SQL + _LOCALS))
def local_part_randomness(spark, sf):
    x = F.split_part("address", F.lit("@"), F.lit(1))
    return doc_addresses(spark, sf).select(x.alias("local")).distinct().select(
        "local", T.is_random_local(F.col("local")).alias("is_random"))


_TRANS = "greatest(len(regexp_extract_all(regexp_replace(s, '[^a-z0-9]', '', 'g'), '[a-z]+|[0-9]+')) - 1, 0)"


@query("lexical_metrics", O.over(
    "SELECT local, length(s) AS length, length(regexp_replace(s, '[^a-z]', '', 'g')) AS alpha_length, "
    "length(regexp_replace(s, '[^0-9]', '', 'g')) AS digit_count, "
    f"{O.round3(O.vowel_ratio('s', '0-9'))} AS digit_ratio, length(regexp_replace(s, '[^aeiouy]', '', 'g')) AS vowel_count, "
    "len(list_distinct(list_filter(string_split(s, ''), lambda c: c <> ''))) AS unique_char_count, "
    "len(list_filter(regexp_extract_all(s, '[0-9a-f]{6,}'), lambda r: regexp_matches(r, '[0-9]'))) > 0 AS has_long_hex_like_run, "
    f"{_TRANS} AS letter_digit_transition_count, length(regexp_replace(s, '[^-]', '', 'g')) AS hyphen_count, "
    f"length(s) >= 6 AND {_TRANS} >= 3 AS many_transitions FROM (SELECT local, lower(local) AS s FROM locals)",
    DOC_ADDRESS_SQL + _LOCALS))
def lexical_metrics(spark, sf):
    local = F.split_part("address", F.lit("@"), F.lit(1)).alias("local")
    rows = doc_addresses(spark, sf).select(local).distinct().select("local", T.lexical_metrics(F.col("local")).alias("m"))
    big = lambda c: F.col(f"m.{c}").cast("bigint").alias(c)
    return rows.select("local", big("length"), big("alpha_length"), big("digit_count"), "m.digit_ratio", big("vowel_count"),
                       big("unique_char_count"), "m.has_long_hex_like_run", big("letter_digit_transition_count"),
                       big("hyphen_count"), T.lexical_flags(F.col("m"))["high_letter_digit_transitions"].alias("many_transitions"))


@query("core_lexical_metrics", O.over(
    f"SELECT local, {O.round3(O.entropy('s'))} AS shannon_entropy, CASE WHEN length(s) > 1 THEN "
    f"{O.round3(O.entropy('s') + ' / log2(length(s))')} ELSE 0.0 END AS normalized_entropy, {O.run('s')} AS max_consonant_run, "
    "list_max(list_transform(range(1, length(s) + 1), lambda i: length(regexp_extract(substring(s, i), "
    "'^(' || regexp_escape(substring(s, i, 1)) || '+)', 1)))) AS max_repeated_char_run, "
    f"{O.round3('len(list_distinct(list_filter(string_split(s, chr(0)[1:0]), lambda c: c <> chr(0)[1:0]))) / length(s)::DOUBLE')} AS unique_char_ratio, "
    "len(regexp_extract_all(s, '[a-z]+|[0-9]+|[^a-z0-9]+')) - 1 - (len(regexp_extract_all(s, '[^a-z0-9]+')) * 2 - "
    "CASE WHEN regexp_matches(s, '^[^a-z0-9]') THEN 1 ELSE 0 END - CASE WHEN regexp_matches(s, '[^a-z0-9]$') THEN 1 ELSE 0 END) AS letter_digit_transitions "
    "FROM (SELECT local, lower(local) AS s FROM locals)", DOC_ADDRESS_SQL + _LOCALS).replace("chr(0)[1:0]", "''"))
def core_lexical_metrics(spark, sf):
    local = F.split_part("address", F.lit("@"), F.lit(1)).alias("local")
    rows = doc_addresses(spark, sf).select(local).distinct().select("local", T.core_lexical_metrics(F.col("local")).alias("m"))
    return rows.select("local", T.round3(F.col("m.shannon_entropy")).alias("shannon_entropy"),
                       T.round3(F.col("m.normalized_entropy")).alias("normalized_entropy"),
                       F.col("m.max_consonant_run").cast("bigint").alias("max_consonant_run"),
                       F.col("m.max_repeated_char_run").cast("bigint").alias("max_repeated_char_run"),
                       T.round3(F.col("m.unique_char_ratio")).alias("unique_char_ratio"),
                       F.col("m.letter_digit_transitions").cast("bigint").alias("letter_digit_transitions"))


_PAIRS = ("words AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS w FROM documents), "
          "pairs AS (SELECT unnest(list_transform(range(1, length(w)), lambda i: substring(w, i, 2))) AS pair FROM words), "
          "counts AS (SELECT pair, count(*) AS n FROM pairs GROUP BY pair)")
_MODEL = (", letters AS (SELECT chr(CAST(96 + i AS INTEGER)) AS c FROM (SELECT unnest(range(1, 27)) AS i)), "
          "cells AS (SELECT a.c AS c1, b.c AS c2, coalesce(n, 1) AS n FROM letters a CROSS JOIN letters b "
          "LEFT JOIN counts ON pair = a.c || b.c), "
          "model AS (SELECT c1 || c2 AS pair, log2(n / sum(n) OVER (PARTITION BY c1)) AS lp FROM cells)")


@query("bigram_counts", O.over("SELECT pair, n FROM counts", _PAIRS))
def bigram_counts(spark, sf):
    return T.bigram_counts(table(spark, sf, "documents"), "text")


@query("bigram_naturalness", O.over(
    f"SELECT label, {O.round3('-sum(lp) / count(*)')} AS avg_neg_log_prob, count(*) AS bigram_count FROM (SELECT label, "
    "unnest(list_transform(range(1, length(s)), lambda i: substring(s, i, 2))) AS pair FROM (SELECT label, "
    "regexp_replace(lower(label), '[^a-z]', '', 'g') AS s FROM labels) WHERE length(s) >= 4) JOIN model USING (pair) GROUP BY label",
    HOST_SQL, _LABELS, _PAIRS + _MODEL))
def bigram_naturalness(spark, sf):
    model = T.bigram_model(T.bigram_counts(table(spark, sf, "documents"), "text"))
    rows = page_labels(spark, sf).select("label", T.bigram_naturalness(F.col("label"), model).alias("b"))
    return rows.where("b IS NOT NULL").select("label", "b.avg_neg_log_prob", F.col("b.bigram_count").cast("bigint").alias("bigram_count"))


@query("heuristic_profile", O.over(
    f"SELECT i.msg_id, CASE WHEN from_local <> '' THEN {O.round3(O.entropy('x'))} END AS local_entropy, "
    "CASE WHEN from_local <> '' THEN length(x) END AS local_length, len(string_split(from_domain, '.')) AS labels, "
    f"{O.round3(O.entropy('l1'))} AS first_label_entropy, CAST({O.run('l1')} AS BIGINT) AS first_label_run "
    "FROM (SELECT *, lower(regexp_replace(from_local, '[^a-zA-Z]', '', 'g')) AS x, split_part(from_domain, '.', 1) AS l1 FROM ident) i "
    "WHERE from_domain IS NOT NULL", O.MAIL))
def heuristic_profile(spark, sf):
    p = FA.heuristic_profile(facts_of()(spark, sf).where("from_domain IS NOT NULL"), [-4.7] * 676)
    first = F.get("from_domain_labels", F.lit(0))
    return p.select("msg_id", F.col("from_local_part.entropy").alias("local_entropy"),
                    F.col("from_local_part.length").cast("bigint").alias("local_length"),
                    F.size("from_domain_labels").cast("bigint").alias("labels"), first["entropy"].alias("first_label_entropy"),
                    first["max_consonant_run"].cast("bigint").alias("first_label_run"))


@query("document_addresses", O.over(
    f"SELECT address, {O.domain_of('lower(address)')} AS email_domain, count(DISTINCT doc_id) AS documents FROM docs GROUP BY 1, 2",
    DOC_ADDRESS_SQL))
def document_addresses(spark, sf):
    return (doc_addresses(spark, sf).groupBy("address").agg(F.count("doc_id").alias("documents"))
            .select("address", A.email_to_domain(F.col("address")).alias("email_domain"), "documents"))


@query("whitelist_entries", O.over("SELECT DISTINCT lower(address) AS value, 'exact' AS match_type FROM docs", DOC_ADDRESS_SQL))
def whitelist_entries(spark, sf):
    return P.whitelist_entries(doc_addresses(spark, sf)).distinct()


@query("mailbox_providers", O.over(
    f"SELECT from_domain AS host, {O.provider('from_domain')} AS provider, count(*) AS messages FROM ident "
    "WHERE from_domain IS NOT NULL GROUP BY 1, 2", O.MAIL))
def mailbox_providers(spark, sf):
    hosts = messages(spark, sf).select(FA.sender_columns(A.mailbox_address(A.header(F.col("headers"), "from")))["from_domain"].alias("host"))
    return (hosts.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("messages"))
            .select("host", FA.mailbox_provider(F.col("host")).alias("provider"), "messages"))


@query("trigram_similarity", O.over(
    f"SELECT p_name, CASE WHEN len(ga) = 0 OR len(gb) = 0 THEN 0.0 ELSE {O.round3('len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb)))::DOUBLE')} END AS similarity "
    "FROM (SELECT DISTINCT p_name, list_distinct(list_transform(range(1, length(s) - 1), lambda i: substring(s, i, 3))) AS ga, "
    "list_distinct(list_transform(range(1, 10), lambda i: substring('smallwidget', i, 3))) AS gb FROM (SELECT p_name, "
    "regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS s FROM part))", "one AS (SELECT 1)"))
def trigram_similarity(spark, sf):
    return table(spark, sf, "part").select("p_name").distinct().select(
        "p_name", N.trigram_jaccard(N.normalise(F.col("p_name")), F.lit("smallwidget")).alias("similarity"))


@query("jaro_similarity")  # checked against a plain implementation in the tests
def jaro_similarity(spark, sf):
    from headrisk.functions.jaro import jaro_similarity as jaro
    return table(spark, sf, "part").select("p_name").distinct().select("p_name", jaro(F.col("p_name"), F.lit("small widget")).alias("similarity"))


@query("non_latin_texts", "SELECT lang, count(*) AS documents, count(*) FILTER (regexp_matches(text, '[\\x{0370}-\\x{06FF}\\x{0900}-\\x{097F}"
       "\\x{0E00}-\\x{0E7F}\\x{1100}-\\x{11FF}\\x{3040}-\\x{30FF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]')) AS non_latin FROM documents GROUP BY lang")
def non_latin_texts(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(
        F.count("*").alias("documents"), F.count_if(N.has_non_latin(F.col("text"))).alias("non_latin"))


@query("message_id_variants", O.over(
    "SELECT msg_id, mid_h AS as_written, substring(mid_h, 2, length(mid_h) - 2) AS bare FROM mail", O.MAIL))
def message_id_variants(spark, sf):
    v = messages(spark, sf).select("msg_id", A.message_id_variants(A.header(F.col("headers"), "message-id")).alias("v"))
    return v.select("msg_id", F.get("v", F.lit(0)).alias("as_written"), F.get("v", F.lit(1)).alias("bare"))


@query("body_snippets", "SELECT conv_id AS msg_id, CASE WHEN length(t) > 160 THEN left(t, 160) || '…' ELSE t END AS snippet FROM ("
       "SELECT conv_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn "
       "FROM conversations WHERE role = 'assistant' AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '') WHERE rn = 1")
def body_snippets(spark, sf):
    parts = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("msg_id"), F.concat(F.lit("0."), F.col("turn").cast("string")).alias("path"),
        F.when(F.col("role") == "assistant", "text/plain; charset=utf-8").otherwise("text/html").alias("content_type"),
        F.col("text").alias("body"))
    return SRC.snippets(parts)
