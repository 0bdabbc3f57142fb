"""Queries over the decision log, reports, protection status, settings and alerts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headrisk import constants as C
from headrisk.functions import address as A
from headrisk.functions.domains import build_domain_dim
from headrisk.operators import alerts as AL
from headrisk.operators import history as H
from headrisk.operators import lookups as L
from headrisk.operators import owners as OW
from headrisk.operators import protection as P
from headrisk.operators import report as RP
from headrisk.operators import rules as R
from headrisk.operators import scoring as S
from headrisk.operators import settings as ST
from headrisk.plans import derived_mail as M
from headrisk.plans import oracle as O
from headrisk.plans.queries import (DOC_ADDRESS_SQL, HOST_SQL, assessed, doc_addresses, facts, facts_of, log, log_heads, looked_up, mailbox, messages,
                                    page_hosts, plan, query, rules, table)
from headrisk.sources import mail as SRC
from headrisk.streaming import jobs as J
from headrisk.streaming.jobs import stream_counts

big = lambda c: F.col(c).cast("bigint").alias(c)

# ------------------------------------------------------------------ rule report

_TYPES = ", ".join(f"('{k}', '{t.replace(chr(39), chr(39) * 2)}', '{ty}', {i})" for i, (k, t, ty, _s) in enumerate(C.RULES))
_RANKS = ", ".join(f"('auth.{m}.{r}', {-10000 + mi * 100 + ri})" for mi, (m, rs) in enumerate(C.AUTH_SCORES.items())
                   for ri, r in enumerate(rs))
REPORT_SQL = f"""
registry AS (SELECT * FROM (VALUES {_TYPES}) AS t(key, title, type, rank)),
auth_rank AS (SELECT * FROM (VALUES {_RANKS}) AS t(key, rank)),
hits AS (SELECT msg_id, key, layer, sum(delta) AS delta, count(*) AS occurrences FROM reasons GROUP BY ALL),
report0 AS (SELECT key, layer, count(*) AS match_count, count(*) FILTER (delta = 0) AS zero_delta_match_count,
  sum(delta) AS total_delta, bool_or(delta > 0) AS up, bool_or(delta < 0) AS down FROM hits GROUP BY key, layer),
report AS (SELECT r.key, r.layer, coalesce(g.title, upper(split_part(r.key, '.', 2)) || ' ' || split_part(r.key, '.', 3)) AS title,
  coalesce(g.type, CASE WHEN r.key LIKE '%.pass' THEN 'diagnostic' ELSE 'risk' END) AS type0, match_count,
  zero_delta_match_count, total_delta, up, down, coalesce(a.rank, g.rank, 10000) AS rank
  FROM report0 r LEFT JOIN registry g USING (key) LEFT JOIN auth_rank a ON a.key = r.key)
"""
_STAGES = (O.MAIL, O.FACTS, O.REASONS, REPORT_SQL)
_TYPE = "CASE WHEN type0 = 'diagnostic' AND (up OR down) THEN CASE WHEN up AND NOT down THEN 'risk' WHEN down AND NOT up THEN 'mitigation' END ELSE type0 END"

report = plan("report", lambda s, sf: RP.rule_report(assessed(s, sf)))


@query("rule_report", O.over(f"SELECT key, layer, title, {_TYPE} AS type, type0 = 'diagnostic' AND NOT (up OR down) AS diagnostic, "
                             "match_count, zero_delta_match_count, total_delta FROM report", *_STAGES))
def rule_report(spark, sf):
    return report(spark, sf).drop("label")


@query("rule_report_sorted", O.over(
    "SELECT row_number() OVER (ORDER BY match_count DESC, layer, rank, key) AS place, key, match_count, "
    "least(1.0, match_count / (SELECT count(*) FROM mail)::DOUBLE) AS share FROM report", *_STAGES))
def rule_report_sorted(spark, sf):
    n = messages(spark, sf).agg(F.count("*").alias("analysed"))
    ranked = RP.rank_rules(report(spark, sf))
    return (ranked.join(F.broadcast(n)).select(  # one row
        big("place"), "key", "match_count", RP.match_share(F.col("match_count"), F.col("analysed")).alias("share")))


@query("rule_report_orders", O.over(
    "SELECT key, row_number() OVER (ORDER BY match_count DESC, layer, rank, key) AS matches_down, row_number() OVER (ORDER BY match_count, layer, rank, key) AS matches_up, "
    "row_number() OVER (ORDER BY layer, rank, key) AS rule_up, row_number() OVER (ORDER BY layer DESC, rank DESC, key DESC) AS rule_down FROM report", *_STAGES))
def rule_report_orders(spark, sf):
    """The place of every rule in each order that a report can be sorted by."""
    ranked = report(spark, sf).select("key", "match_count")
    for name, key, direction in (("matches_down", "matches", None), ("matches_up", "matches", "asc"), ("rule_up", "rule", None), ("rule_down", "rule", "desc")):
        ranked = RP.rank_rules(ranked, key, direction).withColumnRenamed("place", name)
    return ranked.select("key", *[big(n) for n in ("matches_down", "matches_up", "rule_up", "rule_down")])


@query("rule_report_filtered", O.over("SELECT key, match_count FROM report WHERE layer = 'L4' AND NOT (type0 = 'diagnostic' AND NOT (up OR down))", *_STAGES))
def rule_report_filtered(spark, sf):
    return RP.filter_rules(report(spark, sf), "L4", include_diagnostic=False).select("key", "match_count")


@query("rule_drilldown", O.over("SELECT msg_id, delta, occurrences FROM hits WHERE key = 'auth.dkim.pass'", *_STAGES))
def rule_drilldown(spark, sf):
    return RP.rule_messages(assessed(spark, sf), "auth.dkim.pass").select("msg_id", "delta", big("occurrences"))


@query("rule_drilldown_page", O.over(
    "SELECT msg_id, position FROM (SELECT msg_id, row_number() OVER (ORDER BY msg_id) AS position FROM hits "
    "WHERE key = 'composite.ownDomainAuthFail') WHERE position BETWEEN 201 AND 300", *_STAGES))
def rule_drilldown_page(spark, sf):
    hits = RP.rule_messages(assessed(spark, sf), "composite.ownDomainAuthFail")
    return RP.page(hits, ["msg_id"], 2).select("msg_id", big("position"))


@query("folder_page", O.over(
    "SELECT msg_id, position FROM (SELECT msg_id, row_number() OVER (ORDER BY received_at, msg_id) AS position, (row_number() OVER (ORDER BY received_at, msg_id) - 1) // 100 AS page, "
    "(count(*) OVER () - 1) // 100 AS last FROM mail WHERE folder_id = 'inbox') WHERE page = least(57, last)", O.MAIL))
def folder_page(spark, sf):
    inbox = RP.scope_by_folder(messages(spark, sf), "inbox").select("msg_id", "received_at")
    order = ["received_at", "msg_id"]
    return RP.read_page(inbox, RP.page_index(inbox, order), order, 57).select("msg_id", big("position"))


@query("page_starts", O.over(
    "SELECT (position - 1) // 100 AS page, position, msg_id FROM (SELECT msg_id, row_number() OVER (ORDER BY received_at, msg_id) AS position FROM mail) WHERE position % 100 = 1", O.MAIL))
def page_starts(spark, sf):
    index = RP.page_index(messages(spark, sf).select("msg_id", "received_at"), ["received_at", "msg_id"])
    return index.select(big("page"), big("position"), "msg_id")


@query("describe_rules", "WITH " + REPORT_SQL.split("hits AS")[0].strip().rstrip(",") +
       ", seen AS (SELECT 'auth.' || m || '.' || r AS key FROM (VALUES ('spf'), ('dkim')) a(m) CROSS JOIN (VALUES ('pass'), ('fail')) b(r) "
       "UNION ALL SELECT 'custom.formula.' || o_orderpriority FROM orders UNION ALL SELECT 'whitelist.manual') "
       "SELECT key, coalesce(g.title, CASE WHEN key LIKE 'auth.%' THEN upper(split_part(key, '.', 2)) || ' ' || split_part(key, '.', 3) "
       "ELSE 'Custom formula: ' || substring(key, 16) END) AS title, coalesce(g.type, CASE WHEN key LIKE '%.pass' THEN 'diagnostic' ELSE 'risk' END) "
       "AS type, count(*) AS n FROM seen LEFT JOIN registry g USING (key) GROUP BY ALL")
def describe_rules(spark, sf):
    keys = table(spark, sf, "orders").select(F.concat(F.lit("custom.formula."), "o_orderpriority").alias("key"))
    fixed = spark.sql("SELECT explode(array('auth.spf.pass', 'auth.spf.fail', 'auth.dkim.pass', 'auth.dkim.fail', 'whitelist.manual')) AS key")
    return (RP.describe_rules(keys.unionByName(fixed).groupBy("key").agg(F.count("*").alias("n")))
            .select("key", "title", "type", "n"))


# ------------------------------------------------------------------ runs and scope

_REQ = ("req AS (SELECT event_id AS pos, user_id * 131 - 4 AS id FROM events), valid AS (SELECT id, min(pos) AS first_pos FROM req "
        "WHERE id >= 0 GROUP BY id), kept AS (SELECT * FROM valid QUALIFY row_number() OVER (ORDER BY first_pos) <= {n}), "
        "tagged AS (SELECT r.pos, r.id AS msg_id, CASE WHEN r.id < 0 THEN 'invalid-id' WHEN k.first_pos = r.pos THEN CASE WHEN o.o_orderkey "
        "IS NULL THEN 'not-found' ELSE 'analysed' END WHEN k.id IS NOT NULL THEN 'duplicate' ELSE 'over-limit' END AS outcome FROM req r "
        "LEFT JOIN kept k ON k.id = r.id LEFT JOIN orders o ON o.o_orderkey = r.id)")


def outcomes(spark, sf, limit) -> DataFrame:
    requested = table(spark, sf, "events").select(F.col("event_id").alias("pos"), (F.col("user_id") * 131 - 4).alias("msg_id"))
    return RP.run_outcomes(RP.tag_requests(requested, RP.resolve_limit(limit)), messages(spark, sf))


_TOTALS = """SELECT *, CASE WHEN requested = 0 THEN 'empty' WHEN failed + skipped + over_limit > 0 THEN 'partial' ELSE 'complete' END AS state
  FROM (SELECT count(*) AS requested, count(*) FILTER (outcome = 'analysed') AS analysed, count(*) FILTER (outcome = 'not-found') AS failed,
        count(*) FILTER (outcome IN ('invalid-id', 'duplicate')) AS skipped, count(*) FILTER (outcome = 'over-limit') AS over_limit FROM tagged {where})"""


@query("run_totals", O.over(_TOTALS.format(where=""), _REQ.format(n=10**9)))
def run_totals(spark, sf):
    return RP.run_state(RP.run_totals(outcomes(spark, sf, None)))


@query("run_totals_limited", O.over(_TOTALS.format(where=""), _REQ.format(n=50)))
def run_totals_limited(spark, sf):
    """A run with a limit of 50 messages: the limit is what this query shows."""
    return RP.run_state(RP.run_totals(outcomes(spark, sf, 50)))


@query("run_totals_complete", O.over(_TOTALS.format(where="WHERE outcome = 'analysed'"), _REQ.format(n=10**9)))
def run_totals_complete(spark, sf):
    """The run again over the messages that could be read: nothing is left over."""
    return RP.run_state(RP.run_totals(outcomes(spark, sf, None).where("outcome = 'analysed'")))


@query("run_rejects", O.over("SELECT pos, msg_id, outcome FROM tagged WHERE outcome <> 'analysed'", _REQ.format(n=10**9)))
def run_rejects(spark, sf):
    return outcomes(spark, sf, None).where("outcome <> 'analysed'").select("pos", "msg_id", "outcome")


@query("run_failures", O.over("SELECT pos, msg_id FROM tagged WHERE outcome = 'not-found'", _REQ.format(n=10**9)))
def run_failures(spark, sf):
    return RP.order_failures(outcomes(spark, sf, None)).select("pos", "msg_id")


@query("run_report", O.over(
    "SELECT key, count(DISTINCT msg_id) AS match_count, sum(delta) AS total_delta FROM reasons JOIN (SELECT msg_id FROM tagged WHERE "
    "outcome = 'analysed') USING (msg_id) GROUP BY key", O.MAIL, O.FACTS, O.REASONS, _REQ.format(n=10**9)))
def run_report(spark, sf):
    requested = table(spark, sf, "events").select(F.col("event_id").alias("pos"), (F.col("user_id") * 131 - 4).alias("msg_id"))
    run = RP.run_report(requested, messages(spark, sf), lambda m: S.score_messages(
        m, M.derived_settings(), rules(spark), M.contacts(spark), M.account_domains(spark, sf)))
    return run["rules"].select("key", "match_count", "total_delta")


@query("scope_by_date", "SELECT o_orderkey AS msg_id FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-15' AND o_orderdate < TIMESTAMP '1997-03-02'")
def scope_by_date(spark, sf):
    return RP.scope_by_date(messages(spark, sf), "1997-01-15", "1997-03-01").select("msg_id")


@query("scope_by_folder", O.over("SELECT msg_id FROM mail WHERE folder_id = 'review'", O.MAIL))
def scope_by_folder(spark, sf):
    return RP.scope_by_folder(messages(spark, sf), "review").select("msg_id")


@query("scope_by_selection", "SELECT o_orderkey AS msg_id, min(event_id) AS pos FROM events JOIN orders ON o_orderkey = user_id * 131 - 4 GROUP BY o_orderkey")
def scope_by_selection(spark, sf):
    selected = table(spark, sf, "events").select(F.col("event_id").alias("pos"), (F.col("user_id") * 131 - 4).alias("msg_id"))
    return RP.scope_by_selection(messages(spark, sf).select("msg_id"), selected)


@query("scope_limit", "SELECT count(*) AS in_scope, greatest(count(*) - 1000, 0) AS excluded FROM orders")
def scope_limit(spark, sf):
    return RP.apply_limit(messages(spark, sf).select("msg_id"), ["msg_id"], 1000)[1]


@query("scope_first_n", "SELECT o_orderkey AS msg_id FROM orders ORDER BY o_orderkey LIMIT 1000")
def scope_first_n(spark, sf):
    return RP.apply_limit(messages(spark, sf).select("msg_id"), ["msg_id"], 1000)[0]


@query("limit_per_folder", O.over("SELECT msg_id, folder_id FROM mail QUALIFY row_number() OVER (PARTITION BY folder_id ORDER BY msg_id) <= 100", O.MAIL))
def limit_per_folder(spark, sf):
    m = messages(spark, sf).select("msg_id", "account_id", "folder_id", "folder_path")
    return RP.limit_per_folder(m, ["msg_id"], 100).select("msg_id", "folder_id")


@query("limit_per_folder_deep", O.over("SELECT msg_id, folder_id, rn FROM (SELECT msg_id, folder_id, row_number() OVER (PARTITION BY folder_id ORDER BY received_at DESC, msg_id) AS rn FROM mail) WHERE rn <= 5000", O.MAIL))
def limit_per_folder_deep(spark, sf):
    m = messages(spark, sf).select("msg_id", "account_id", "folder_id", "folder_path", "received_at")
    return RP.limit_per_folder(m, ["received_at DESC", "msg_id"], 5000).select("msg_id", "folder_id", big("rn"))


@query("scope_folders", O.over("SELECT DISTINCT folder_id, folder_name, folder_type FROM mail", O.MAIL))
def scope_folders(spark, sf):
    return RP.scope_folders(messages(spark, sf)).select("folder_id", "folder_name", "folder_type")


# ------------------------------------------------------------------ actions and alerts

def review_folders(spark, sf) -> DataFrame:
    """Every third account has a review folder."""
    return (table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("a")).distinct().where("a % 3 = 0")
            .select(F.concat(F.lit("account"), F.col("a").cast("string")).alias("account_id"), F.lit("review").alias("review_folder_id")))


_HAS_REVIEW = "CAST(substring(account_id, 8) AS INTEGER) % 3 = 0"


@query("route_messages", O.over(
    f"SELECT msg_id, CASE WHEN classification = 'normal' THEN 'classified-normal' WHEN classification = 'high-risk' THEN 'move-junk' "
    f"WHEN {_HAS_REVIEW} THEN 'move-review' ELSE 'no-review-folder-configured' END AS action FROM assessed"))
def route_messages(spark, sf):
    return S.route(assessed(spark, sf).select("msg_id", "account_id", "classification"),
                   M.derived_settings().with_(move_high_risk_to_junk=True), review_folders(spark, sf)).select("msg_id", "action")


@query("alert_eligible", O.over("SELECT msg_id, score FROM assessed WHERE score <= 49"))
def alert_eligible(spark, sf):
    return AL.alert_eligible(assessed(spark, sf).select("msg_id", "score"), M.derived_settings().with_(alert_enabled=True))


@query("still_eligible", O.over("SELECT msg_id FROM assessed WHERE score <= 49 AND NOT junk AND folder_type NOT IN ('junk', 'trash', 'spam')"))
def still_eligible(spark, sf):
    alerts = AL.alert_eligible(assessed(spark, sf).select("msg_id", "score"), M.derived_settings().with_(alert_enabled=True))
    return AL.still_eligible(alerts, mailbox(spark, sf)).select("msg_id")


@query("in_review_folder", O.over(f"SELECT msg_id, CASE WHEN {_HAS_REVIEW} THEN folder_id = 'review' ELSE folder_name = 'Auth Review' END AS in_review FROM mail", O.MAIL))
def in_review_folder(spark, sf):
    return H.in_review_folder(mailbox(spark, sf), review_folders(spark, sf)).select("msg_id", "in_review")


@query("alert_texts", O.over(
    "SELECT msg_id, CASE WHEN msg_id % 3 = 0 THEN 'New Messages' ELSE (CASE WHEN msg_id % 3 = 1 THEN account_id || '@home-corp.com' ELSE folder_name END) || ': 1 new message' END AS title, "
    "CASE WHEN msg_id % 3 = 0 THEN 'There are 3 new messages.' || chr(10) ELSE '' END || from_h || chr(10) || subject || "
    "CASE WHEN msg_id % 3 = 0 THEN chr(10) || '+2 more messages' ELSE '' END AS body FROM mail", O.MAIL))
def alert_texts(spark, sf):
    m = messages(spark, sf)
    n = F.col("msg_id") % 3
    t = AL.alert_text(F.when(n == 0, 3).otherwise(1), F.when(n == 1, F.concat("account_id", F.lit("@home-corp.com"))),
                      F.lit(None).cast("string"), F.col("folder_name"), A.header(F.col("headers"), "from"), F.col("subject"),
                      F.lit(None).cast("string"))
    return m.select("msg_id", t.alias("t")).select("msg_id", "t.*")


def event_alerts(spark, sf) -> DataFrame:
    """Events as alert requests: the user owns the alert, the event type is its folder."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("owner"), at.alias("at_ms"),
        F.col("event_id").alias("msg_id"), F.col("event_type").alias("group_key"), (F.col("event_type") != "error").alias("eligible"))


@query("pending_alerts",
       "WITH RECURSIVE e AS (SELECT DISTINCT user_id AS msg_id, epoch_us(ts) // 1000 AS at_ms FROM events), "
       "kept AS (SELECT msg_id, min(at_ms) AS at_ms FROM e GROUP BY msg_id UNION ALL "
       "SELECT k.msg_id, (SELECT min(at_ms) FROM e WHERE e.msg_id = k.msg_id AND e.at_ms >= k.at_ms + 3600000) FROM kept k "
       "WHERE k.at_ms IS NOT NULL) SELECT msg_id, at_ms FROM kept WHERE at_ms IS NOT NULL")
def pending_alerts(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("msg_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return AL.pending_alerts(e, 3_600_000)


def event_changes(spark, sf) -> DataFrame:
    """Events of a user as those of a message: views and clicks ask for an alert, the others tell where the message is."""
    kind = F.when(F.col("event_type").isin("view", "click"), "alert").when(F.col("event_type") == "signup", "deleted").otherwise("moved")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("msg_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), kind.alias("kind"), F.lit(False).alias("junk"),
        F.when(F.col("event_type") == "error", "trash").otherwise("inbox").alias("folder_type"))


@query("settled_alerts",
       "WITH RECURSIVE c AS (SELECT user_id AS msg_id, epoch_us(ts) // 1000 AS at_ms, event_type IN ('error', 'signup') AS gone FROM events WHERE event_type NOT IN ('view', 'click')), "
       "e AS (SELECT DISTINCT user_id AS msg_id, epoch_us(ts) // 1000 AS at_ms FROM events WHERE event_type IN ('view', 'click')), "
       "kept AS (SELECT msg_id, min(at_ms) AS at_ms FROM e GROUP BY msg_id UNION ALL "
       "SELECT k.msg_id, (SELECT min(at_ms) FROM e WHERE e.msg_id = k.msg_id AND e.at_ms >= k.at_ms + 3600000) FROM kept k WHERE k.at_ms IS NOT NULL), "
       "seen AS (SELECT k.msg_id, k.at_ms, max_by(c.gone, c.at_ms * 2 + c.gone::INT) AS gone FROM kept k LEFT JOIN c ON c.msg_id = k.msg_id AND c.at_ms < k.at_ms + 3600000 "
       "AND c.at_ms >= k.at_ms + 3600000 - 43200000 WHERE k.at_ms IS NOT NULL GROUP BY k.msg_id, k.at_ms) "
       "SELECT msg_id, at_ms AS requested_at, at_ms + 3600000 AS shown_at FROM seen WHERE NOT coalesce(gone, false)")
def settled_alerts(spark, sf):
    return AL.settled_alerts(event_changes(spark, sf), 3_600_000, 43_200_000)


@query("paced_alerts")  # a state machine over time; tested against a plain simulation
def paced_alerts(spark, sf):
    return AL.paced_alerts(event_alerts(spark, sf), interval_ms=7_200_000)


@query("alert_counts_by_hour", "SELECT epoch_ms(time_bucket(INTERVAL 1 hour, ts)) AS window_ms, event_type AS classification, count(*) AS n FROM events GROUP BY ALL")
def alert_counts_by_hour(spark, sf):
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("assessed_at"), F.col("event_type").alias("classification"))
    return stream_counts(e).select(F.unix_millis("window_start").alias("window_ms"), "classification", "n")


# ------------------------------------------------------------------ decision log

_LOG = ("lg AS (SELECT a.*, epoch_ms(received_at) AS at_ms, s.ids FROM assessed a LEFT JOIN (SELECT msg_id, list(authserv_id ORDER BY "
        "NOT trusted, ar_pos) AS ids FROM (SELECT msg_id, authserv_id, trusted, min(ar_pos) AS ar_pos FROM heads GROUP BY ALL) GROUP BY msg_id) s USING (msg_id))")
_L = (O.MAIL, O.FACTS, O.REASONS, _LOG)


@query("logged_servers", O.over("SELECT msg_id, coalesce(array_to_string(ids, ','), '') AS ids FROM lg", *_L))
def logged_servers(spark, sf):
    return facts_of()(spark, sf).select("msg_id", F.array_join(H.logged_servers(F.col("auth"))["ids"], ",").alias("ids"))


WHAT_IF = M.derived_settings().with_(
    auth_scores={**C.AUTH_SCORES, "spf": {**C.AUTH_SCORES["spf"], "fail": 20}, "dkim": {**C.AUTH_SCORES["dkim"], "pass": -5}},
    heuristic_scores={"randomFromDomainLabel": 30, "randomFromLocalPart": 0}, composite_scores={"ownDomainAuthFail": 10},
    whitelist_score=-10)
_NEW = ("CASE WHEN key = 'auth.spf.fail' THEN 20 WHEN key = 'auth.dkim.pass' THEN -5 WHEN key = 'heuristic.randomFromDomainLabel' THEN 30 "
        "WHEN key = 'heuristic.randomFromLocalPart' THEN 0 WHEN key = 'composite.ownDomainAuthFail' THEN 10 WHEN key = 'whitelist.manual' THEN -10 "
        "WHEN key = 'composite.dkimAlignedLexicalMitigation' AND NOT has_label THEN 0 ELSE delta END")


@query("rescore", O.over(
    f"SELECT msg_id, original_score, current_score, original_classification, CASE WHEN current_score >= 100 THEN 'high-risk' "
    f"WHEN current_score >= 50 THEN 'review' ELSE 'normal' END AS current_classification, changed FROM (SELECT a.msg_id, a.score AS original_score, "
    f"a.classification AS original_classification, coalesce(sum(CASE WHEN layer <> 'L3' THEN nd END), 0.0) + "
    f"least(coalesce(sum(CASE WHEN layer = 'L3' THEN nd END), 0.0), 25.0) AS current_score, count(*) FILTER (nd <> delta) AS changed FROM assessed a "
    f"LEFT JOIN (SELECT *, CAST({_NEW} AS DOUBLE) AS nd FROM (SELECT *, bool_or(key = 'heuristic.randomFromDomainLabel') OVER (PARTITION BY msg_id) "
    f"AS has_label FROM reasons)) r USING (msg_id) GROUP BY ALL)"))
def rescore(spark, sf):
    r = H.rescore(log(spark, sf), WHAT_IF)
    return r.select("msg_id", "original_score", "current_score", "original_classification", "current_classification",
                    F.size("reason_diffs").cast("bigint").alias("changed"))


@query("activity_summary", O.over(
    "SELECT count(*) AS total, count(*) FILTER (classification = 'normal') AS normal, count(*) FILTER (classification = 'review') AS review, "
    "count(*) FILTER (classification = 'high-risk') AS high_risk FROM assessed"))
def activity_summary(spark, sf):
    return H.activity_summary(log(spark, sf))


@query("recent_log", O.over("SELECT msg_id, score FROM lg ORDER BY at_ms DESC, msg_id DESC LIMIT 50", *_L))
def recent_log(spark, sf):
    return H.recent(log(spark, sf), 50).select("msg_id", "score")


@query("newest_per_account", O.over("SELECT account_id, msg_id FROM lg QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY at_ms DESC, msg_id DESC) <= 20", *_L))
def newest_per_account(spark, sf):
    return H.newest_per_account(log_heads(spark, sf)).select("account_id", "msg_id")


@query("retained_log", O.over("SELECT account_id, count(*) AS n, min(at_ms) AS oldest_ms FROM (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY account_id "
                              "ORDER BY at_ms DESC, msg_id DESC) <= 1000) GROUP BY account_id", *_L))
def retained_log(spark, sf):
    kept = H.retain_latest(log_heads(spark, sf).select("account_id", "msg_id", "assessed_at"))
    return kept.groupBy("account_id").agg(F.count("*").alias("n"), F.unix_millis(F.min("assessed_at").cast("timestamp")).alias("oldest_ms"))


_DT = "CASE WHEN delta > 0 THEN '+' ELSE '' END || CAST(CAST(delta AS BIGINT) AS VARCHAR)"
_LABELS = ", ".join("('{}', '{}')".format(k, C.reason_label(k).replace("'", "''")) for k, *_ in C.RULES)
_LABEL = "coalesce(lb.label, upper(split_part(key, '.', 2)) || ' ' || split_part(key, '.', 3))"


@query("top_reasons", O.over(
    f"SELECT a.msg_id, coalesce(t.s, '') AS top_reasons FROM assessed a LEFT JOIN (SELECT msg_id, string_agg({_LABEL} || ': ' || {_DT}, ' · ' ORDER BY abs(delta) DESC, ord) AS s "
    f"FROM (SELECT * FROM reasons WHERE delta <> 0 QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY abs(delta) DESC, ord) <= 3) r "
    f"LEFT JOIN (VALUES {_LABELS}) AS lb(k, label) ON lb.k = key GROUP BY msg_id) t USING (msg_id)"))
def top_reasons(spark, sf):
    return log(spark, sf).select("msg_id", H.top_reasons_text(F.col("score_reasons")).alias("top_reasons"))


@query("non_zero_reasons", O.over("SELECT a.msg_id, count(r.key) AS n FROM assessed a LEFT JOIN (SELECT * FROM reasons WHERE delta <> 0) r USING (msg_id) GROUP BY a.msg_id"))
def non_zero_reasons(spark, sf):
    return log(spark, sf).select("msg_id", F.size(H.non_zero_reasons(F.col("score_reasons"))).cast("bigint").alias("n"))


@query("reason_texts", O.over(
    f"SELECT msg_id, ord_n AS seq, {_LABEL} || ': ' || {_DT} || CASE WHEN key = 'heuristic.randomFromDomainLabel' THEN ' (label: ' || random_label || ')' "
    "WHEN key = 'composite.authAlignedRandomDomain' THEN ' (' || from_domain || ')' WHEN key = 'sender.rule' THEN ' (bulk.net suffix)' ELSE '' END AS text "
    f"FROM (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY ord) - 1 AS ord_n FROM reasons) r JOIN (SELECT msg_id, from_domain, random_label FROM facts) f USING (msg_id) "
    f"LEFT JOIN (VALUES {_LABELS}) AS lb(k, label) ON lb.k = key WHERE layer <> 'L1'"))
def reason_texts(spark, sf):
    r = S.reasons_table(assessed(spark, sf)).where("layer <> 'L1'")
    text = H.reason_text(F.struct("key", "label", "delta", "ctx"))
    return r.select("msg_id", big("seq"), text.alias("text"))


@query("reason_context", O.over("SELECT msg_id, 'from_domain' AS ctx_key, from_domain AS ctx_value FROM reasons JOIN (SELECT msg_id, from_domain FROM facts) f USING (msg_id) "
                                "WHERE key = 'composite.unauthenticatedFromSpoof'"))
def reason_context(spark, sf):
    r = S.reasons_table(assessed(spark, sf)).where("key = 'composite.unauthenticatedFromSpoof'")
    return H.reason_context(r).where("ctx_key = 'from_domain'").select("msg_id", "ctx_key", "ctx_value")


@query("protective_facts", O.over(
    "SELECT msg_id, 'mitigation' AS fact_key, key AS score_key, delta FROM reasons WHERE delta < 0 UNION ALL "
    "SELECT msg_id, 'dkimAligned', NULL, NULL FROM assessed WHERE "
    "EXISTS (SELECT 1 FROM reasons r WHERE r.msg_id = assessed.msg_id AND delta > 0) AND msg_id IN (SELECT msg_id FROM facts WHERE dkim_aligned) UNION ALL "
    "SELECT msg_id, 'noTrustedAuth', NULL, NULL FROM (SELECT msg_id FROM reasons GROUP BY msg_id HAVING bool_or(key = 'authserv.untrusted') AND NOT bool_or(key LIKE 'auth.%')) UNION ALL "
    "SELECT msg_id, 'belowThreshold', NULL, NULL FROM assessed WHERE score > 0 AND score < 100"))
def protective_facts(spark, sf):
    return H.protective_facts(log(spark, sf)).select("msg_id", "fact_key", "score_key", "delta")


@query("export_verdicts", O.over(
    "SELECT msg_id, true AS found, folder_id AS current_folder_id, CASE WHEN junk THEN 'spam' WHEN folder_name = 'Auth Review' THEN 'undecided' "
    "ELSE 'ham' END AS export_verdict FROM mail", O.MAIL))
def export_verdicts(spark, sf):
    r = H.resolve_log(log_heads(spark, sf).select("msg_id", "account_id", "rfc_message_id"), mailbox(spark, sf), ["archive"])
    return r.select("msg_id", "found", "current_folder_id", "export_verdict")


_COPIES = ("box AS (SELECT msg_id * 2 AS m, substring(mid_h, 2, length(mid_h) - 2) AS k, account_id, folder_name, junk FROM mail WHERE msg_id % 7 <> 0 "
           "UNION ALL SELECT msg_id * 2 + 1, mid_h, 'account' || CAST((CAST(substring(account_id, 8) AS INTEGER) + 1) % 20 AS VARCHAR), 'Copy', false FROM mail WHERE msg_id % 3 = 0)")


@query("ambiguous_exports", O.over(
    "SELECT l.msg_id, count(b.m) AS match_count, CASE WHEN count(b.m) = 0 THEN 'unknown' WHEN coalesce(arg_min(b.junk, CASE WHEN b.account_id = l.account_id THEN 0 ELSE 1 END * 10 + "
    "CASE WHEN b.k = l.mid_h THEN 0 ELSE 1 END), false) THEN 'spam' WHEN arg_min(b.folder_name, CASE WHEN b.account_id = l.account_id THEN 0 ELSE 1 END * 10 + "
    "CASE WHEN b.k = l.mid_h THEN 0 ELSE 1 END) = 'Auth Review' THEN 'undecided' ELSE 'ham' END AS export_verdict FROM mail l LEFT JOIN box b ON b.k = l.mid_h "
    "OR b.k = substring(l.mid_h, 2, length(l.mid_h) - 2) GROUP BY l.msg_id", O.MAIL, _COPIES))
def ambiguous_exports(spark, sf):
    m = mailbox(spark, sf)
    shift = F.concat(F.lit("account"), ((F.substring("account_id", 8, 3).cast("int") + 1) % 20).cast("string"))
    originals = m.where("msg_id % 7 <> 0").select((F.col("msg_id") * 2).alias("msg_id"), "header_message_id", "account_id", "folder_id", "folder_name", "folder_type", "junk")
    copies = m.where("msg_id % 3 = 0").select((F.col("msg_id") * 2 + 1).alias("msg_id"), F.concat(F.lit("<"), "header_message_id", F.lit(">")).alias("header_message_id"),
                                              shift.alias("account_id"), F.lit("copy").alias("folder_id"), F.lit("Copy").alias("folder_name"),
                                              F.lit("folder").alias("folder_type"), F.lit(False).alias("junk"))
    r = H.resolve_log(log_heads(spark, sf).select("msg_id", "account_id", "rfc_message_id"), originals.unionByName(copies), [])
    return r.select("msg_id", F.coalesce("match_count", F.lit(0)).alias("match_count"), "export_verdict")


_SHARED = ("logged AS (SELECT msg_id, account_id, received_at, CASE WHEN msg_id % 3 = 0 THEN '<shared@id.test>' ELSE mid_h END AS mid FROM mail), "
           "boxed AS (SELECT msg_id AS m, account_id AS a, CASE WHEN msg_id % 5 = 0 THEN 'shared@id.test' ELSE substring(mid_h, 2, length(mid_h) - 2) END AS k FROM mail), "
           "per AS (SELECT k, a, min(m) AS m, count(*) AS n FROM boxed GROUP BY k, a), anywhere AS (SELECT k, min(m) AS m, sum(n) AS n FROM per GROUP BY k)")


@query("shared_message_id", O.over(
    "SELECT l.msg_id, CAST(y.n AS BIGINT) AS match_count, x.m IS NOT NULL AS in_own_account, 'account' || CAST(o_custkey % 20 AS VARCHAR) AS current_account_id "
    "FROM logged l LEFT JOIN anywhere y ON y.k = substring(mid, 2, length(mid) - 2) LEFT JOIN per x ON x.k = y.k AND x.a = l.account_id "
    "LEFT JOIN orders o ON o.o_orderkey = coalesce(x.m, y.m)", O.MAIL, _SHARED))
def shared_message_id(spark, sf):
    """A third of the log and a fifth of the mailbox share one Message-ID, in all accounts."""
    entries = log_heads(spark, sf).select("msg_id", "account_id", F.when(F.col("msg_id") % 3 == 0, "<shared@id.test>").otherwise(F.col("rfc_message_id")).alias("rfc_message_id"))
    box = mailbox(spark, sf).withColumn("header_message_id", F.when(F.col("msg_id") % 5 == 0, "shared@id.test").otherwise(F.col("header_message_id")))
    r = H.resolve_log(entries, box, [])
    return r.select("msg_id", "match_count", F.coalesce(F.col("current_account_id") == F.col("account_id"), F.lit(False)).alias("in_own_account"), "current_account_id")


@query("find_log_entries", O.over("SELECT mid_h AS rfc_message_id, a.msg_id, score FROM assessed a WHERE a.msg_id IN (SELECT user_id * 131 - 4 FROM events)"))
def find_log_entries(spark, sf):
    wanted = table(spark, sf, "events").select((F.col("user_id") * 131 - 4).alias("msg_id")).distinct().join(
        log_heads(spark, sf).select("msg_id", F.concat(F.col("rfc_message_id"), F.lit(" ")).alias("rfc_message_id")), "msg_id").select("rfc_message_id")
    return H.find_log_entry(log(spark, sf), wanted).select("rfc_message_id", "msg_id", "score")


# ------------------------------------------------------------------ formulas

FORMULAS = (
    ("boost", "Boost", C.FORMULA_STARTERS[0][1], "add"), ("deep", "", C.FORMULA_STARTERS[1][1], "observe"),
    ("mid", "", C.FORMULA_STARTERS[2][1], "add"), ("dkim", "", C.FORMULA_STARTERS[3][1], "add"),
    ("clamped", "", "clamp(scoreOf('auth.spf.fail') * 10, 0, 250)", "observe"),
    ("named", "", "CASE WHEN nameContains('Amazon Sup') OR match(from_.domain, '^SHOP', 'i') THEN 5 ELSE 0 END", "observe"),
    ("broken", "", "no_such_column + 1", "add"), ("text", "", "verdict", "add"), ("off", "", "1", "disabled"),
)
with_formulas = plan("with_formulas", lambda s, sf: S.score_facts(
    S.with_lookups(facts(s, sf), M.derived_settings(), M.contacts(s), M.account_domains(s, sf)), M.derived_settings().with_(formulas=FORMULAS)))

_FX = ("fx AS (SELECT a.msg_id, a.score AS base, CASE WHEN bool_or(r.key = 'composite.authAlignedRandomDomain') THEN 30.0 ELSE 0.0 END AS boost, "
       "CASE WHEN max(f.mid_reg) <> max(f.from_reg) AND NOT bool_or(f.dkim_aligned) THEN 30.0 ELSE 0.0 END AS mid, "
       "CASE WHEN bool_or(f.dkim_aligned) THEN -20.0 ELSE 0.0 END AS dkim, CASE WHEN max(f.from_depth) >= 2 AND "
       f"{O.entropy('split_part(max(f.from_domain), chr(46), 1)')} > 2.4 THEN 40.0 ELSE 0.0 END AS deep, "
       "least(greatest(coalesce(max(CASE WHEN r.key = 'auth.spf.fail' THEN r.delta END), 0.0) * 10, 0.0), 100.0) AS clamped, "
       "CASE WHEN coalesce(contains(max(f.name_norm), 'amazonsup'), false) OR starts_with(coalesce(max(f.from_domain), ''), 'shop') THEN 5.0 ELSE 0.0 END AS named "
       "FROM assessed a JOIN facts f USING (msg_id) LEFT JOIN reasons r USING (msg_id) GROUP BY a.msg_id, a.score)")


@query("apply_formulas", O.over(
    "SELECT msg_id, CAST(base + boost + mid + dkim AS DOUBLE) AS score, CAST(boost AS DOUBLE) AS boost, CAST(deep AS DOUBLE) AS deep, CAST(mid AS DOUBLE) AS mid, "
    "CAST(dkim AS DOUBLE) AS dkim, CAST(clamped AS DOUBLE) AS clamped, CAST(named AS DOUBLE) AS named, 2 AS failed FROM fx", O.MAIL, O.FACTS, O.REASONS, _FX))
def apply_formulas(spark, sf):
    value = lambda i: F.get("formula_diagnostics", F.lit(i))["value"]
    return with_formulas(spark, sf).select(
        "msg_id", "score", *[value(i).alias(n) for i, n in enumerate(("boost", "deep", "mid", "dkim", "clamped", "named"))],
        F.size(F.filter("formula_diagnostics", lambda d: d["error"].isNotNull())).alias("failed"))


BAD_FORMULAS = (("cast", "", "from_.domain + 1", "add"), ("overflow", "", "length(from_.domain) * 2147483647 * 2147483647 * 0 + 3", "add"), ("parse", "", "1 +", "add"),
                ("number", "", "1e999", "add"), ("kinds", "", "CASE WHEN from_.domain = 5 THEN 1 ELSE 0 END", "add"), ("reads", "", "CASE WHEN 1 IN (TABLE orders) THEN 1 ELSE 0 END", "add"),
                ("pattern", "", "CASE WHEN match(from_.domain, '(?P<n>a)') THEN 1 ELSE 0 END", "observe"), ("root", "", "sqrt(-1 - from_.subdomain_depth)", "add"),
                ("good", "", "floor(length(from_.domain))", "add"), ("fine", "", "round(try_divide(length(from_.domain), 3), 2)", "add"),
                *((f"n{i}", "", "1", "observe") for i in range(10)), ("late", "", "100", "add"))


@query("formula_failures", O.over(
    "SELECT a.msg_id, CAST(a.score + 3 * (from_domain IS NOT NULL)::INT + coalesce(length(from_domain), 0) + coalesce(round(length(from_domain) / 3.0, 2), 0) AS DOUBLE) AS score, "
    "CASE WHEN from_domain IS NULL THEN 'cast fine good kinds late number overflow parse pattern reads root' ELSE 'cast kinds late number parse pattern reads root' END AS failed "
    "FROM assessed a JOIN (SELECT msg_id, 1 AS one FROM facts) USING (msg_id)"))
def formula_failures(spark, sf):
    scored = S.score_facts(looked_up(spark, sf), M.derived_settings().with_(formulas=BAD_FORMULAS))
    failed = F.array_sort(F.transform(F.filter("formula_diagnostics", lambda d: d["error"].isNotNull()), lambda d: d["id"]))
    return scored.select("msg_id", "score", F.array_join(failed, " ").alias("failed"))


@query("formula_verdicts", O.over(
    "SELECT old || ' -> ' || new AS would_change_verdict, count(*) AS n FROM (SELECT CASE WHEN base >= 100 THEN 'high-risk' WHEN base >= 50 THEN 'review' ELSE 'normal' END AS old, "
    "CASE WHEN base + deep >= 100 THEN 'high-risk' WHEN base + deep >= 50 THEN 'review' ELSE 'normal' END AS new FROM fx) WHERE old <> new GROUP BY 1", O.MAIL, O.FACTS, O.REASONS, _FX))
def formula_verdicts(spark, sf):
    d = with_formulas(spark, sf).select(F.explode("formula_diagnostics").alias("d")).select("d.*")
    return d.where("id = 'deep' AND would_change_verdict IS NOT NULL").groupBy("would_change_verdict").agg(F.count("*").alias("n"))


@query("last_formula_results", O.over(
    "SELECT id, CASE id WHEN 'boost' THEN boost WHEN 'deep' THEN deep WHEN 'mid' THEN mid WHEN 'dkim' THEN dkim WHEN 'clamped' THEN clamped WHEN 'named' THEN named END::DOUBLE AS value "
    "FROM (SELECT * FROM fx JOIN (SELECT msg_id, received_at FROM mail) USING (msg_id) ORDER BY received_at DESC, msg_id DESC LIMIT 1) "
    "CROSS JOIN (VALUES ('boost'), ('deep'), ('mid'), ('dkim'), ('clamped'), ('named'), ('broken'), ('text')) AS v(id)", O.MAIL, O.FACTS, O.REASONS, _FX))
def last_formula_results(spark, sf):
    entries = with_formulas(spark, sf).select("msg_id", F.col("received_at").alias("assessed_at"), "formula_diagnostics")
    return H.last_formula_results(entries).select("id", "diagnostic.value")


# ------------------------------------------------------------------ protection status

def accounts(spark, sf) -> DataFrame:
    """Twenty accounts with mail and five without."""
    n = table(spark, sf, "customer").select((F.col("c_custkey") % 25).alias("a")).distinct()
    return n.select(F.concat(F.lit("account"), F.col("a").cast("string")).alias("account_id"))


def setups(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(F.concat(F.lit("account"), F.col("c_custkey").cast("string")).alias("account_id"),
                    F.when(F.col("c_custkey") % 2 == 0, "mx.example.net").when(F.col("c_custkey") % 3 == 0, "bad host!")
                    .otherwise("gone.example.org").alias("host"), (F.col("c_custkey") * 7 % 11).alias("confirmed_at"))


def trusted_table(spark) -> DataFrame:
    return spark.createDataFrame(list(M.derived_settings().trusted_servers), "value string, match_type string")


_MAILS = ("am AS (SELECT account_id, count(*) AS total, count(*) FILTER (t) AS trusted, count(*) FILTER (NOT t AND ids IS NOT NULL) AS untrusted, "
          "count(*) FILTER (ids IS NULL) AS none, count(*) FILTER (list_contains(ids, 'gw.trusted.org')) AS host_seen FROM (SELECT *, coalesce(len(list_filter(ids, lambda i: i = 'mx.example.net' OR i = 'trusted.org' OR i LIKE '%.trusted.org')) > 0, false) AS t "
          "FROM lg QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY at_ms DESC, msg_id DESC) <= 20) GROUP BY account_id)")


@query("account_mail", O.over("SELECT account_id, total, trusted, untrusted, none, host_seen FROM am", *_L, _MAILS))
def account_mail(spark, sf):
    hosts = accounts(spark, sf).select("account_id", F.lit(" GW.trusted.org").alias("host"))
    return P.account_mail(log_heads(spark, sf), M.derived_settings(), hosts).select("account_id", "total", "trusted", "untrusted", "none", "host_seen")


_STATUS = ("ps AS (SELECT a.account_id, CASE WHEN coalesce(trusted, 0) > 0 THEN 'active' WHEN coalesce(untrusted, 0) > 0 THEN 'needs_confirmation' "
           "WHEN total >= 5 AND none = total THEN 'no_usable_ar' ELSE 'awaiting_mail' END AS state, CASE WHEN CAST(substring(a.account_id, 8) AS INTEGER) % 2 = 0 "
           "THEN 'mx.example.net' END AS confirmed_host FROM (SELECT DISTINCT 'account' || CAST(c_custkey % 25 AS VARCHAR) AS account_id FROM customer) a LEFT JOIN am USING (account_id))")


@query("protection_status", O.over("SELECT account_id, state, confirmed_host FROM ps", *_L, _MAILS, _STATUS))
def protection_status(spark, sf):
    return P.protection_status(accounts(spark, sf), log_heads(spark, sf), setups(spark, sf), trusted_table(spark), M.derived_settings()) \
        .select("account_id", "state", "confirmed_host")


@query("protection_summary", O.over("SELECT count(*) AS total, count(*) FILTER (state = 'active') AS active, count(*) FILTER (state <> 'active') AS inactive, "
                                    "bool_and(state = 'active') AS all_active FROM ps", *_L, _MAILS, _STATUS))
def protection_summary(spark, sf):
    return P.protection_summary(P.protection_status(accounts(spark, sf), log_heads(spark, sf), setups(spark, sf), trusted_table(spark), M.derived_settings()))


@query("confirmed_hosts", "SELECT 'account' || CAST(c_custkey AS VARCHAR) AS account_id, 'mx.example.net' AS confirmed_host FROM customer WHERE c_custkey % 2 = 0")
def confirmed_hosts(spark, sf):
    return P.confirmed_hosts(setups(spark, sf), trusted_table(spark))


@query("latest_setups", "SELECT account_id, host, confirmed_at FROM (SELECT 'account' || CAST(c_custkey AS VARCHAR) AS account_id, CASE WHEN c_custkey % 2 = 0 THEN 'mx.example.net' "
       "WHEN c_custkey % 3 = 0 THEN NULL ELSE 'gone.example.org' END AS host, c_custkey * 7 % 11 AS confirmed_at FROM customer) WHERE host IS NOT NULL "
       "ORDER BY confirmed_at DESC, account_id LIMIT 10")
def latest_setups(spark, sf):
    return P.latest_setups(setups(spark, sf), 10)


# ------------------------------------------------------------------ identities and setup

def identities(spark, sf) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("owner"), (c % 40).cast("string")).alias("account_id"), c.alias("pos"),
        F.when(c % 11 == 0, "no address").otherwise(F.concat(F.lit("U"), c.cast("string"), F.lit("@mail"), (c % 3).cast("string"), F.lit(".Shop"),
                                                            (c % 4).cast("string"), F.lit(".co.jp"))).alias("email"))


_IDS = ("ids AS (SELECT 'owner' || CAST(c_custkey % 40 AS VARCHAR) AS account_id, c_custkey AS pos, CASE WHEN c_custkey % 11 = 0 THEN 'no address' ELSE "
        "'U' || CAST(c_custkey AS VARCHAR) || '@mail' || CAST(c_custkey % 3 AS VARCHAR) || '.Shop' || CAST(c_custkey % 4 AS VARCHAR) || '.co.jp' END AS email FROM customer), "
        "doms AS (SELECT account_id, lower(split_part(email, '@', 2)) AS domain, min(pos) AS pos FROM ids WHERE email LIKE '%@%' GROUP BY ALL)")


@query("setup_accounts", O.over("SELECT account_id, (SELECT count(*) FROM ids i WHERE i.account_id = d.account_id AND email LIKE '%@%') AS emails, string_agg(domain, ',' ORDER BY pos) AS domains "
                                "FROM doms d GROUP BY account_id", _IDS))
def setup_accounts(spark, sf):
    return P.setup_accounts(identities(spark, sf)).select("account_id", F.size("emails").cast("bigint").alias("emails"), F.array_join("domains", ",").alias("domains"))


@query("own_domains", O.over(f"SELECT account_id, string_agg(DISTINCT {O.reg('domain')}, ',' ORDER BY {O.reg('domain')}) AS domains FROM doms GROUP BY account_id", _IDS))
def own_domains(spark, sf):
    return P.load_identities(identities(spark, sf), rules(spark)).select("account_id", F.array_join("account_domains", ",").alias("domains"))


def mx_answers(spark, sf) -> DataFrame:
    """DNS answers for the mail domains of suppliers' customers, as JSON."""
    k = F.col("s_suppkey")
    answer = F.to_json(F.struct(F.when(k % 5 == 0, 3).when(k % 7 == 0, 2).otherwise(0).alias("Status"), F.array(
        F.struct(F.lit(15).alias("type"), F.concat((k % 3 * 10).cast("string"), F.lit(" MX"), k.cast("string"), F.lit(".Host.net.")).alias("data")),
        F.struct(F.lit(1).alias("type"), F.lit("10.0.0.1").alias("data")),
        F.struct(F.lit(15).alias("type"), F.concat(F.lit("x backup"), (k % 2).cast("string"), F.lit(".host.net")).alias("data"))).alias("Answer")))
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("mail"), (k % 3).cast("string"), F.lit(".shop"), (k % 4).cast("string"), F.lit(".co.jp")).alias("domain"), answer.alias("answer"))


_MX = ("mx AS (SELECT 'mail' || CAST(k % 3 AS VARCHAR) || '.shop' || CAST(k % 4 AS VARCHAR) || '.co.jp' AS domain, unnest(['mx' || CAST(k AS VARCHAR) || '.host.net', "
       "'backup' || CAST(k % 2 AS VARCHAR) || '.host.net']) AS exchange, unnest([k % 3 * 10, 10]) AS priority FROM (SELECT s_suppkey AS k FROM supplier WHERE "
       "s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0))")


@query("mx_records", O.over("SELECT domain, exchange, CAST(priority AS INTEGER) AS priority FROM mx", _MX))
def mx_records(spark, sf):
    return SRC.mx_records(mx_answers(spark, sf)).select("domain", "exchange", "priority")


@query("mx_status", "SELECT 'mail' || CAST(s_suppkey % 3 AS VARCHAR) || '.shop' || CAST(s_suppkey % 4 AS VARCHAR) || '.co.jp' AS domain, s_suppkey % 5 = 0 OR s_suppkey % 7 <> 0 AS ok "
       "FROM supplier")
def mx_status(spark, sf):
    return SRC.mx_status(mx_answers(spark, sf)).select("domain", "ok")


_PREFIXES = ", ".join(f"'{p}'" for p in C.HOST_PREFIXES)


@query("setup_suggestions", O.over(
    f"SELECT account_id, host, arg_min(source, g) AS source FROM (SELECT account_id, p || domain AS host, 'heuristic' AS source, 0 AS g FROM doms CROSS JOIN "
    f"(SELECT unnest([{_PREFIXES}]) AS p) UNION ALL SELECT account_id, exchange, 'mx', 1 FROM doms JOIN mx USING (domain)) GROUP BY account_id, host", _IDS, _MX))
def setup_suggestions(spark, sf):
    return P.setup_suggestions(identities(spark, sf), SRC.mx_records(mx_answers(spark, sf))).select("account_id", "host", "source")


@query("setup_checks")  # a checklist built from many joins; each item is tested on a fixture
def setup_checks(spark, sf):
    own = identities(spark, sf)
    choices = own.groupBy("account_id").agg(F.max("pos").alias("p")).select("account_id", F.when(F.col("p") % 4 == 0, "gw.trusted.org").when(
        F.col("p") % 4 == 1, "mail1.shop1.co.jp").when(F.col("p") % 4 == 2, "other.shop2.co.jp").otherwise("bad host!").alias("host"))
    entries = log_heads(spark, sf).withColumn("account_id", F.regexp_replace("account_id", "account", "owner"))
    mail = P.account_mail(entries, M.derived_settings(), choices)
    return P.check_setup(choices, P.setup_accounts(own), P.setup_suggestions(own, SRC.mx_records(mx_answers(spark, sf))), M.derived_settings(), mail, rules(spark))


# ------------------------------------------------------------------ trust entries and candidates

def proposed(spark, sf) -> DataFrame:
    """Page hosts as proposed trust entries, some of them malformed."""
    h = page_hosts(spark, sf).groupBy("host").agg(F.count("*").alias("n"))
    value = F.when(F.length("host") % 7 == 0, F.concat("host", F.lit(" !"))).when(F.length("host") % 11 == 0, "com").when(F.length("host") % 13 == 0, " ").otherwise(F.col("host"))
    return h.select("host", value.alias("value"), F.when(F.col("n") % 2 == 0, "domain").otherwise("exact").alias("match_type"))


_PROPOSED = ("prop AS (SELECT host, CASE WHEN length(host) % 7 = 0 THEN host || ' !' WHEN length(host) % 11 = 0 THEN 'com' WHEN length(host) % 13 = 0 THEN ' ' ELSE host END AS value, "
             "CASE WHEN n % 2 = 0 THEN 'domain' ELSE 'exact' END AS match_type FROM (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1))")


@query("check_trust_entries", O.over(
    f"SELECT host, match_type, CASE WHEN trim(value) = '' THEN 'empty' WHEN value LIKE '% !' THEN 'invalid_host' WHEN match_type = 'domain' AND ({O.reg('value')}) IS NULL THEN 'public_suffix' "
    f"WHEN match_type = 'domain' AND ({O.reg('value')}) <> value THEN 'not_registrable' WHEN match_type = 'exact' AND value LIKE 'blog.%' THEN 'duplicate' END AS error FROM prop", _PROPOSED))
def check_trust_entries(spark, sf):
    existing = page_hosts(spark, sf).where("host LIKE 'blog.%'").select(F.col("host").alias("value"), F.lit(None).cast("string").alias("match_type"))
    return P.check_trust_entries(proposed(spark, sf), existing, rules(spark)).select("host", "match_type", "error")


@query("valid_trust_entries", O.over("SELECT value, match_type FROM prop WHERE match_type = 'domain'", _PROPOSED))
def valid_trust_entries(spark, sf):
    p = proposed(spark, sf).select("value", F.when(F.col("match_type") == "exact", "regex").otherwise(F.col("match_type")).alias("match_type"))
    return P.valid_trust_entries(p)


@query("promotable_domains", O.over(
    f"SELECT DISTINCT value, {O.reg('value')} AS registrable_domain FROM prop WHERE match_type = 'exact' AND value NOT LIKE '% !' AND trim(value) <> '' "
    f"AND ({O.reg('value')}) IS NOT NULL AND ({O.reg('value')}) NOT IN (SELECT value FROM prop WHERE match_type = 'domain')", _PROPOSED))
def promotable_domains(spark, sf):
    return P.promotable_domains(proposed(spark, sf).where("trim(value) <> ''"), rules(spark)).distinct()


def candidates(spark, sf) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("authserv_id"))
    c = p.groupBy("authserv_id").agg(F.max("page_id").alias("last_seen"))
    dim = build_domain_dim(c.select(F.col("authserv_id").alias("host")), rules(spark)).select(F.col("host").alias("authserv_id"), "registrable_domain")
    return c.join(dim, "authserv_id")


_CANDS = (f"cand AS (SELECT authserv_id, last_seen, {O.reg('authserv_id')} AS registrable_domain FROM (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS authserv_id, "
          "max(page_id) AS last_seen FROM pages GROUP BY 1))")


def candidate_trust(spark, sf) -> DataFrame:
    return (page_hosts(spark, sf).where("host LIKE 'm.%'").select(F.col("host").alias("value"), F.lit("exact").alias("match_type")).distinct()
            .unionByName(spark.sql("SELECT 'example.net' AS value, 'domain' AS match_type")))


@query("untrusted_candidates", O.over("SELECT authserv_id, last_seen FROM cand WHERE authserv_id NOT LIKE 'm.%' AND registrable_domain <> 'example.net'", _CANDS))
def untrusted_candidates(spark, sf):
    return P.drop_trusted_candidates(candidates(spark, sf), candidate_trust(spark, sf)).select("authserv_id", "last_seen")


@query("pruned_candidates", O.over("SELECT authserv_id, last_seen FROM cand ORDER BY last_seen DESC, authserv_id LIMIT 50", _CANDS))
def pruned_candidates(spark, sf):
    return P.prune_candidates(candidates(spark, sf)).select("authserv_id", "last_seen")


@query("candidates_by_domain", O.over("SELECT registrable_domain, count(*) AS servers, max(last_seen) AS last_seen FROM (SELECT * FROM cand ORDER BY last_seen DESC, authserv_id LIMIT 50) GROUP BY 1", _CANDS))
def candidates_by_domain(spark, sf):
    pruned = P.prune_candidates(candidates(spark, sf)).drop("registrable_domain")
    return P.candidates_by_domain(pruned, rules(spark)).select("registrable_domain", "servers", "last_seen")


@query("promoted_candidates", O.over("SELECT authserv_id FROM cand WHERE registrable_domain <> 'example.org' AND authserv_id NOT LIKE 'www.%'", _CANDS))
def promoted_candidates(spark, sf):
    c = candidates(spark, sf)
    choices = (c.where("authserv_id LIKE 'www.%'").select(F.col("authserv_id").alias("value"), F.lit("exact").alias("match_type"))
               .unionByName(spark.sql("SELECT 'example.org' AS value, 'domain' AS match_type")))
    return P.promote_candidates(c, choices, candidate_trust(spark, sf))["candidates"].select("authserv_id")


@query("promoted_trust", O.over("SELECT DISTINCT authserv_id AS value, 'exact' AS match_type FROM cand WHERE authserv_id LIKE 'www.%' OR authserv_id LIKE 'm.%' UNION "
                                "SELECT 'example.net', 'domain' UNION SELECT 'example.org', 'domain'", _CANDS))
def promoted_trust(spark, sf):
    c = candidates(spark, sf)
    choices = (c.where("authserv_id LIKE 'www.%'").select(F.col("authserv_id").alias("value"), F.lit("exact").alias("match_type"))
               .unionByName(spark.sql("SELECT 'example.org' AS value, 'domain' AS match_type")))
    return P.promote_candidates(c, choices, candidate_trust(spark, sf))["trusted"]


def requests(spark, sf) -> DataFrame:
    p = table(spark, sf, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    return p.select("page_id", F.when(F.col("page_id") % 13 == 0, "").otherwise(F.concat(F.lit("account"), (F.col("page_id") % 30).cast("string"))).alias("account_id"),
                    F.when(F.col("page_id") % 17 == 0, F.concat(host, F.lit("_!"))).otherwise(F.upper(host)).alias("host"),
                    (F.col("page_id") % 5 != 0).alias("confirmed"), F.col("page_id").alias("confirmed_at"))


_REQUESTS = ("rq AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'confirmation_required' WHEN page_id % 13 = 0 THEN 'missing_account' WHEN page_id % 17 = 0 THEN 'invalid_host' END AS error, "
             "'account' || CAST(page_id % 30 AS VARCHAR) AS account_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages)")


@query("confirmation_rejects", O.over("SELECT page_id, error FROM rq WHERE error IS NOT NULL", _REQUESTS))
def confirmation_rejects(spark, sf):
    return P.confirm_servers(requests(spark, sf), candidate_trust(spark, sf), candidates(spark, sf))["rejects"].select("page_id", "error")


@query("confirmed_servers", O.over("SELECT DISTINCT host AS value, 'exact' AS match_type FROM rq WHERE error IS NULL AND host NOT LIKE 'm.%' AND host NOT LIKE '%.example.net'", _REQUESTS))
def confirmed_servers(spark, sf):
    return P.confirm_servers(requests(spark, sf), candidate_trust(spark, sf), candidates(spark, sf))["added"]


@query("confirmed_setups", O.over("SELECT account_id, arg_max(host, page_id) AS host, max(page_id) AS confirmed_at FROM rq WHERE error IS NULL GROUP BY account_id", _REQUESTS))
def confirmed_setups(spark, sf):
    return P.confirm_servers(requests(spark, sf), candidate_trust(spark, sf), candidates(spark, sf))["setups"]


# ------------------------------------------------------------------ settings tables

def stored_weights(spark, sf) -> DataFrame:
    """Every supplier is a tenant whose weights are one of the earlier defaults, some changed in one key."""
    n = len(C.EARLIER_SCORES)
    profiles = ST.earlier_profiles(spark).collect()
    sets = F.array(*[F.struct(F.lit(p["group"]).alias("group"), F.array(*[F.struct(F.lit(e["key"]).alias("key"), F.lit(e["weight"]).alias("weight"))
                                                                         for e in p["entries"]]).alias("entries")) for p in profiles])
    k = F.col("s_suppkey")
    picked = table(spark, sf, "supplier").select(k, F.get(sets, (k % n).cast("int")).alias("p"))
    rows = picked.select(k, "p.group", F.posexplode("p.entries").alias("i", "e"))
    return rows.select(k.cast("string").alias("tenant"), "group", "e.key", F.when((k % 5 == 0) & (F.col("i") == 0), F.col("e.weight") + 1).otherwise(F.col("e.weight")).alias("weight"))


def versions(spark, sf) -> DataFrame:
    v = F.array(*[F.lit(p) for p, _g, _s in C.EARLIER_SCORES])
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").where("s_suppkey % 3 <> 0").select(k.cast("string").alias("tenant"), F.when(k % 7 == 0, C.SCORES_VERSION).when(
        k % 4 == 0, "v1").otherwise(F.get(v, (k % len(C.EARLIER_SCORES)).cast("int"))).alias("version"))


_PROFILE_ROWS = ", ".join(f"({i}, '{v}', '{g}', '{k}', {w}, {j})" for i, (v, g, s) in enumerate(C.EARLIER_SCORES) for j, (k, w) in enumerate(sorted(ST._flat(s).items())))
_NOW = ", ".join(f"('{g}', '{k}', {w})" for g, s in ST.GROUPS.items() for k, w in ST._flat(s).items())
_STORED = (f"prof AS (SELECT * FROM (VALUES {_PROFILE_ROWS}) AS t(i, version, grp, key, weight, j)), now AS (SELECT * FROM (VALUES {_NOW}) AS t(grp, key, weight)), "
           f"stored AS (SELECT CAST(s_suppkey AS VARCHAR) AS tenant, s_suppkey AS k, version AS own, grp, key, CAST(weight + CASE WHEN s_suppkey % 5 = 0 AND j = 0 THEN 1 ELSE 0 END AS DOUBLE) AS weight "
           f"FROM supplier JOIN prof ON i = s_suppkey % {len(C.EARLIER_SCORES)}), sets AS (SELECT i, version, grp, string_agg(key || '=' || CAST(CAST(weight AS INTEGER) AS VARCHAR), ',' ORDER BY key) AS s FROM prof GROUP BY ALL), "
           "mine AS (SELECT tenant, k, own, grp, string_agg(key || '=' || CAST(CAST(weight AS INTEGER) AS VARCHAR), ',' ORDER BY key) AS s FROM stored GROUP BY ALL), "
           "vers AS (SELECT tenant, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 7 = 0 THEN 'v3' WHEN k % 4 = 0 THEN 'v1' ELSE own END AS version, grp, s FROM mine), "
           "old AS (SELECT tenant, grp FROM vers v WHERE coalesce(version, '') <> 'v3' AND EXISTS (SELECT 1 FROM sets WHERE sets.grp = v.grp AND sets.s = v.s AND (v.version IS NULL OR v.version = sets.version)))")


@query("migrate_weights", O.over(
    'SELECT tenant, grp AS "group", key, weight, false AS migrated FROM stored WHERE (tenant, grp) NOT IN (SELECT (tenant, grp) FROM old) UNION ALL '
    'SELECT tenant, grp, key, CAST(weight AS DOUBLE), true FROM old JOIN now USING (grp)', _STORED))
def migrate_weights(spark, sf):
    return ST.migrate_weights(stored_weights(spark, sf), versions(spark, sf))


@query("merge_weights", O.over(
    'SELECT t.tenant, grp AS "group", key, CAST(coalesce(s.weight, now.weight) AS DOUBLE) AS weight, s.weight IS NOT NULL AS stored FROM (SELECT DISTINCT tenant FROM stored) t CROSS JOIN now '
    'LEFT JOIN stored s USING (tenant, grp, key)', _STORED))
def merge_weights(spark, sf):
    return ST.merge_weights(stored_weights(spark, sf))


def formula_rows(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.concat(F.lit("t"), F.floor(k / 25).cast("string")).alias("tenant"), (k % 25).cast("int").alias("pos"),
        F.when(k % 10 == 0, "").when(k % 11 == 0, F.col("p_name")).otherwise(F.concat(F.lit("f"), (k % 23).cast("string"))).alias("id"),
        F.when(k % 29 == 0, F.repeat("p_name", 30)).otherwise(F.col("p_name")).alias("name"),
        F.when(k % 13 == 0, "").when(k % 17 == 0, "match(from_.domain, 'x')").otherwise("base_score").alias("expression"),
        F.when(k % 19 == 0, "boost").when(k % 2 == 0, "add").otherwise("observe").alias("mode"))


_FORMS = ("fm AS (SELECT 't' || CAST(p_partkey // 25 AS VARCHAR) AS tenant, p_partkey % 25 AS pos, p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN '' WHEN p_partkey % 11 = 0 THEN p_name "
          "ELSE 'f' || CAST(p_partkey % 23 AS VARCHAR) END AS id, CASE WHEN p_partkey % 29 = 0 THEN repeat(p_name, 30) ELSE p_name END AS name FROM part)")


@query("check_formulas", O.over(
    "SELECT tenant, pos, CASE WHEN id = '' THEN 'id_required' WHEN contains(id, ' ') THEN 'id_invalid' WHEN count(*) OVER (PARTITION BY tenant, id) > 1 THEN 'id_duplicate' "
    "WHEN length(name) > 200 THEN 'name_too_long' WHEN k % 13 = 0 THEN 'expression_required' WHEN k % 19 = 0 THEN 'invalid_mode' WHEN k % 17 = 0 AND k % 2 = 0 THEN 'match_in_add_mode' END AS error FROM fm", _FORMS))
def check_formulas(spark, sf):
    return ST.check_formulas(formula_rows(spark, sf)).select("tenant", big("pos"), "error")


@query("formulas_over_limit", O.over("SELECT tenant, pos, id, 'over_limit' AS error FROM fm WHERE pos >= 20", _FORMS))
def formulas_over_limit(spark, sf):
    return ST.formulas_over_limit(formula_rows(spark, sf)).select("tenant", big("pos"), "id", "error")


@query("read_formulas", O.over("SELECT tenant, pos, id, left(name, 200) AS name, CASE WHEN k % 19 = 0 THEN 'observe' WHEN k % 2 = 0 THEN 'add' ELSE 'observe' END AS mode FROM fm WHERE pos < 20", _FORMS))
def read_formulas(spark, sf):
    return ST.read_formulas(formula_rows(spark, sf)).select("tenant", big("pos"), "id", "name", "mode")


@query("contacts", "SELECT DISTINCT address FROM (SELECT unnest([lower(c_name) || '@a.net', CASE WHEN c_custkey % 2 = 0 THEN 'second' || CAST(c_custkey % 9 AS VARCHAR) || '@b.net' END]) AS address FROM customer "
       "WHERE c_custkey % 5 <> 0) WHERE address IS NOT NULL")
def contacts(spark, sf):
    k = F.col("c_custkey")
    books = table(spark, sf, "customer").select(
        F.lit("book").alias("book_id"), F.when(k % 5 == 0, "mailingList").when(k % 3 == 0, "contact").alias("type"),
        F.concat("c_name", F.lit("@A.net")).alias("primary_email"),
        F.when(k % 2 == 0, F.concat(F.lit("Second"), (k % 9).cast("string"), F.lit("@b.net"))).alias("second_email"))
    return SRC.contacts_of(books)


# ------------------------------------------------------------------ settings by account

# account k trusts less where k % 4 = 3, weighs differently, and has its own lists
_ACCOUNT = "CAST(regexp_extract(account_id, '([0-9]+)', 1) AS INT)"


def owner_tables(spark, sf) -> OW.OwnerTables:
    """Settings of the derived mail's accounts; account0 has stored nothing."""
    k = F.expr(_ACCOUNT)
    own = M.account_domains(spark, sf).select("account_id", k.alias("k")).where("k > 0")
    weight = lambda g, key, w: F.struct(F.lit(g).alias("group"), F.lit(key).alias("key"), w.cast("double").alias("weight"))
    k = F.col("k")
    weights = own.select("account_id", F.explode(F.array(
        weight("auth", "spf.fail", k), weight("auth", "dmarc.quarantine", k * 2), weight("identity", "dkimDomainMismatch", k * 3),
        weight("heuristic", "layer3Cap", k), weight("composite", "ownDomainAuthFail", -k), weight("composite", "dkimFailWithAlignedPass", k + 0.5))).alias("w")) \
        .select("account_id", "w.*")
    trust = own.select("account_id", F.explode(F.when(k % 4 == 3, F.array(F.struct(F.lit("unknown.test").alias("value"), F.lit("domain").alias("match_type")))).otherwise(
        F.array(*[F.struct(F.lit(v).alias("value"), F.lit(t).alias("match_type")) for v, t in ((M.T.upper(), "exact"), ("trusted.org", "domain"))]))).alias("t")) \
        .select("account_id", "t.*")
    whitelist = own.where("k % 2 = 0").select("account_id", F.lit(0).alias("pos"), F.lit("Friend@Partner.com").alias("value"), F.lit("exact").alias("match_type"))
    rule = lambda pos, d, t, score: F.struct(F.lit(pos).alias("pos"), F.lit(d).alias("domain"), F.lit(t).alias("match_type"), score.cast("double").alias("score"))
    senders = own.select("account_id", F.explode(F.array(
        rule(0, "A.bulk.net", "exact", -k), rule(1, "bulk.net", "suffix", k + 20), rule(2, "bulk.net", "exact", k), rule(3, "com", "suffix", k * 0))).alias("r")) \
        .select("account_id", "r.*")
    options = own.select("account_id", (k * -1).alias("address_book_score"), (k % 3 == 1).alias("address_book_enabled"))
    return OW.OwnerTables(OW.owner_parameters(weights, None, options), trust, whitelist, senders)


_OWNERS = "own AS (SELECT msg_id, CAST(regexp_extract(account_id, '([0-9]+)', 1) AS INT) AS k FROM mail)"
_OWN_MAIL = O.MAIL.replace("ars AS (", _OWNERS + ",\nars AS (", 1).replace(
    "id = 'mx.example.net' OR id = 'trusted.org' OR id LIKE '%.trusted.org' AS trusted",
    "CASE WHEN k = 0 THEN false WHEN k % 4 = 3 THEN id = 'unknown.test' OR id LIKE '%.unknown.test' "
    "ELSE id = 'mx.example.net' OR id = 'trusted.org' OR id LIKE '%.trusted.org' END AS trusted").replace(
    "'\\s+[0-9]+$', '') AS id FROM ars)", "'\\s+[0-9]+$', '') AS id FROM ars JOIN own USING (msg_id))")
_OWN_REASONS = f"""
mine AS (
  SELECT msg_id, layer, ord, key, k, CAST(CASE
      WHEN key = 'auth.spf.fail' AND k > 0 THEN k WHEN key = 'identity.dkimDomainMismatch' AND k > 0 THEN 3 * k
      WHEN key = 'composite.ownDomainAuthFail' AND k > 0 THEN -k WHEN key = 'composite.dkimFailWithAlignedPass' AND k > 0 THEN k + 0.5
      WHEN key = 'whitelist.addressBook' THEN -k ELSE delta END AS DOUBLE) AS delta
  FROM reasons JOIN own USING (msg_id)
  WHERE NOT (key = 'sender.rule') AND NOT (key = 'whitelist.manual' AND (k = 0 OR k % 2 = 1)) AND NOT (key = 'whitelist.addressBook' AND k % 3 <> 1)
  UNION ALL
  SELECT f.msg_id, 'L5', 5003 + pos, 'sender.rule', k, CAST(score AS DOUBLE)
  FROM facts f JOIN own USING (msg_id), LATERAL (SELECT * FROM (VALUES (0, 'a.bulk.net', 'exact', -k), (1, 'bulk.net', 'suffix', k + 20),
    (2, 'bulk.net', 'exact', k), (3, 'com', 'suffix', 0)) AS r(pos, domain, kind, score)) r
  WHERE k > 0 AND (from_domain = domain OR (kind = 'suffix' AND from_domain LIKE '%.' || domain))),
sums AS (
  SELECT msg_id, coalesce(sum(delta) FILTER (layer <> 'L3'), 0) + least(coalesce(sum(delta) FILTER (layer = 'L3'), 0),
    CASE WHEN any_value(k) = 0 THEN {C.HEURISTIC_SCORES['layer3Cap']} ELSE any_value(k) END) AS s, string_agg(key, ' ' ORDER BY ord) AS keys
  FROM mine GROUP BY msg_id)
"""


@query("scores_by_owner", O.over(
    "SELECT m.msg_id, m.account_id, CAST(coalesce(s, 0) AS DOUBLE) AS score, CASE WHEN coalesce(s, 0) >= 100 THEN 'high-risk' WHEN coalesce(s, 0) >= 50 THEN 'review' "
    "ELSE 'normal' END AS classification, coalesce(keys, '') AS reason_keys FROM mail m LEFT JOIN sums USING (msg_id)", _OWN_MAIL, O.FACTS, O.REASONS, _OWN_REASONS))
def scores_by_owner(spark, sf):
    full = OW.assess_by_owner(messages(spark, sf), owner_tables(spark, sf), rules(spark), M.contacts(spark), M.account_domains(spark, sf))
    return full.select("msg_id", "account_id", "score", "classification", F.array_join(F.transform("score_reasons", lambda r: r["key"]), " ").alias("reason_keys"))


# a rule for every line of every order, and for the suffixes of the hosts themselves
_HOST_RULES = (HOST_SQL + ", host_rules AS (SELECT 4 * l_orderkey * 10 + l_linenumber AS pos, 'Shop' || l_partkey || '.example' AS domain, 'suffix' AS match_type, 1.0 AS score FROM lineitem "
               "UNION ALL SELECT length(host), substring(host, instr(host, '.') + 1), CASE WHEN length(host) % 2 = 0 THEN 'suffix' ELSE 'exact' END, length(host) FROM hosts "
               "UNION ALL SELECT 100 + length(host), upper(host), CASE WHEN length(host) % 3 = 0 THEN 'suffix' ELSE 'exact' END, -length(host) FROM hosts)")


@query("sender_rules_by_host", "WITH " + _HOST_RULES +
       " SELECT host, string_agg(domain || '/' || match_type || '/' || CAST(CAST(score AS INT) AS VARCHAR), ' ' ORDER BY pos, domain, match_type, score) AS rules FROM hosts JOIN host_rules "
       "ON host = lower(domain) OR (match_type = 'suffix' AND ends_with(host, '.' || lower(domain))) WHERE host <> '' GROUP BY host")
def sender_rules_by_host(spark, sf):
    hosts = page_hosts(spark, sf).select(F.lower("host").alias("host")).distinct()
    n = F.length("host")
    lines = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 40 + F.col("l_linenumber")).alias("pos"), F.concat(F.lit("Shop"), "l_partkey", F.lit(".example")).alias("domain"),
                                                F.lit("suffix").alias("match_type"), F.lit(1.0).alias("score"))
    above = hosts.select(n.cast("bigint").alias("pos"), F.expr("substring(host, instr(host, '.') + 1)").alias("domain"),
                         F.when(n % 2 == 0, "suffix").otherwise("exact").alias("match_type"), n.cast("double").alias("score"))
    equal = hosts.select((n + 100).cast("bigint").alias("pos"), F.upper("host").alias("domain"), F.when(n % 3 == 0, "suffix").otherwise("exact").alias("match_type"),
                         (-n).cast("double").alias("score"))
    found = L.suffix_matches(hosts, lines.unionByName(above).unionByName(equal))
    return found.select("host", F.array_join(F.transform("sender_hits", lambda r: F.concat_ws("/", r["domain"], r["match_type"], r["score"].cast("int").cast("string"))), " ").alias("rules"))


# ------------------------------------------------------------------ rules of the caller's own, the stored log

OWN_RULES = R.STANDARD.without("composite.authAlignedRandomDomain", "identity.dkimDomainMismatch").with_rule(
    R.Rule("own.longLocalPart", "L4", lambda: F.length("from_local") >= 6, 12.0, "Long local part", lambda: {"local_part": F.col("from_local")}),
    R.Rule("own.subject", "L3", lambda: F.col("subject").endswith("URGENT"), 30.0, "Urgent subject"))


@query("scores_with_own_rules", O.over(
    "SELECT m.msg_id, CAST(coalesce(s, 0) AS DOUBLE) AS score, coalesce(keys, '') AS reason_keys FROM mail m LEFT JOIN (SELECT msg_id, coalesce(sum(delta) FILTER (layer <> 'L3'), 0) + "
    f"least(coalesce(sum(delta) FILTER (layer = 'L3'), 0), {C.HEURISTIC_SCORES['layer3Cap']}) AS s, string_agg(key, ' ' ORDER BY ord) AS keys FROM changed GROUP BY msg_id) USING (msg_id)",
    O.MAIL, O.FACTS, O.REASONS,
    "changed AS (SELECT msg_id, layer, ord, key, delta FROM reasons WHERE key NOT IN ('composite.authAlignedRandomDomain', 'identity.dkimDomainMismatch') "
    "UNION ALL SELECT msg_id, 'L4', 4901, 'own.longLocalPart', 12 FROM facts WHERE length(from_local) >= 6 UNION ALL SELECT msg_id, 'L3', 4902, 'own.subject', 30 FROM facts WHERE subject LIKE '%URGENT')"))
def scores_with_own_rules(spark, sf):
    scored = S.score_facts(looked_up(spark, sf), M.derived_settings(), rule_set=OWN_RULES)
    return scored.select("msg_id", "score", F.array_join(F.transform("score_reasons", lambda r: r["key"]), " ").alias("reason_keys"))


@query("stored_log", O.over(
    "SELECT a.msg_id, score, CASE WHEN classification = 'normal' THEN 'classified-normal' WHEN classification = 'high-risk' THEN 'move-junk' "
    f"WHEN {_HAS_REVIEW} THEN 'move-review' ELSE 'no-review-folder-configured' END AS action, coalesce(h.authserv_id, '') AS authserv_id, h.trusted, "
    "date_trunc('year', a.received_at)::DATE AS assessed_on, row_number() OVER (PARTITION BY account_id ORDER BY a.received_at DESC, a.msg_id DESC) <= 100 AS retained "
    "FROM assessed a LEFT JOIN (SELECT msg_id, authserv_id, trusted FROM heads WHERE ar_pos = 0) h USING (msg_id)"))
def stored_log(spark, sf):
    """Two batches written by the sink, one of them twice, read back, and the compacted newest hundred of each account.

    Messages are scored once, into a table that both batches and the replay are taken from."""
    entries = S.route(assessed(spark, sf), M.derived_settings().with_(move_high_risk_to_junk=True), review_folders(spark, sf))
    rows = H.full_log_entries(entries, F.col("received_at"), F.col("action"))
    root = spark.conf.get(J.CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(J.CHECKPOINT_CONF) or tempfile.mkdtemp()
    path = f"{root.rstrip('/')}/decision-log-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/entries")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/entries")
    write = J.log_sink(f"{path}/batches", "mail", "year")
    for batch in (0, 1, 1):
        write(rows.where(F.col("msg_id") % 2 == batch), batch)
    kept = J.compact_log(spark, f"{path}/batches", f"{path}/compacted", 100, period="year").select("msg_id", F.lit(True).alias("retained"))
    return J.read_log_sink(spark, f"{path}/batches").join(kept, "msg_id", "left").select(
        "msg_id", "score", "action", "authserv_id", "trusted", "assessed_on", F.coalesce("retained", F.lit(False)).alias("retained"))
