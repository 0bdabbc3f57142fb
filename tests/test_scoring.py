from conftest import mail
from pyspark.sql import functions as F

from headrisk.operators import history as H
from headrisk.operators import report as RP
from headrisk.operators.auth import parse_auth_results
from headrisk.operators.formulas import FormulaError, check_formula
from headrisk.operators.scoring import assess, score_messages
from headrisk.settings import Settings

TRUST = Settings(trusted_servers=(("mx.example.net", "exact"), ("trusted.org", "domain")))


def keys(spark, suffixes, headers, settings=TRUST):
    row = score_messages(mail(spark, headers), settings, suffixes).first()
    return [r["key"] for r in row["score_reasons"]], row["score"], row["classification"]


def parsed(spark, *values):
    df = mail(spark, {"authentication-results": list(values)}).select(parse_auth_results(F.col("headers"), TRUST).alias("a"))
    return df.first()["a"]


def test_parse_results(spark):
    a, = parsed(spark, 'mx.example.net 1 ; spf=pass (sender ok; really) smtp.mailfrom=B@Esp.net reason="a; b"; dkim/1=fail header.i=@Sig.com')
    assert a["authserv_id"] == "mx.example.net" and a["trusted"]
    spf, dkim = a["results"]
    assert (spf["method"], spf["result"], spf["mail_from_domain"]) == ("spf", "pass", "esp.net")
    assert spf["properties"]["reason"] == "a; b"
    assert (dkim["method"], dkim["result"], dkim["signing_domain"]) == ("dkim", "fail", "sig.com")


def test_trailing_text_keeps_a_header_untrusted(spark):
    a, b, c = parsed(spark, "mx.example.net junk; dmarc=fail", "gw.trusted.org; none", "nottrusted.org; spf=pass")
    assert (a["authserv_id"], a["trusted"]) == ("mx.example.net junk", False)
    assert (b["trusted"], b["results"]) == (True, [])
    assert c["trusted"] is False


def test_repeated_property_counts_last(spark):
    a, = parsed(spark, "mx.example.net; dkim=pass header.d=one.com header.d=two.com")
    assert a["results"][0]["signing_domain"] == "two.com"


def test_trusted_failures(spark, suffixes):
    got = keys(spark, suffixes, {"from": "Alice <alice@example.com>", "message-id": "<1@example.com>",
                                 "authentication-results": "mx.example.net; spf=fail smtp.mailfrom=alice@example.com; dkim=none; dmarc=fail"})
    assert got[0] == ["auth.spf.fail", "auth.dkim.none", "auth.dmarc.fail"] and got[1:] == (70.0, "review")


def test_untrusted_results_do_not_score(spark, suffixes):
    got = keys(spark, suffixes, {"from": "a@example.com", "authentication-results": "other.test; spf=fail; dmarc=fail"})
    assert got == (["authserv.untrusted"], 0.0, "normal")


def test_heuristics_are_capped(spark, suffixes):
    s = TRUST.with_(heuristic_scores={"randomFromDomainLabel": 20, "randomFromLocalPart": 20})
    ks, score, _ = keys(spark, suffixes, {"from": "xkqvbtzm@xkqvbtzw.com"}, s)
    assert ks == ["heuristic.randomFromDomainLabel", "heuristic.randomFromLocalPart"] and score == 25.0


def test_every_matching_sender_rule_scores(spark, suffixes):
    s = TRUST.with_(sender_rules=(("bulk.net", "suffix", 20.0), ("a.bulk.net", "exact", 5.0), ("ulk.net", "suffix", 9.0)))
    assert keys(spark, suffixes, {"from": "d@a.bulk.net"}, s)[:2] == (["sender.rule", "sender.rule"], 25.0)


def test_helo_stands_in_only_without_from_domain(spark, suffixes):
    headers = {"from": "undisclosed", "message-id": "<1@esp.net>",
               "authentication-results": "mx.example.net; spf=pass smtp.helo=out.esp.net"}
    assert "composite.unparseableFromWithInfrastructureMismatch" not in keys(spark, suffixes, headers)[0]
    headers["authentication-results"] = "mx.example.net; spf=none"
    assert "composite.unparseableFromWithInfrastructureMismatch" in keys(spark, suffixes, headers)[0]


def test_consistency_rules(spark, suffixes):
    spoof = {"from": "V <victim@example.com>", "message-id": "<a@sendgrid.net>",
             "authentication-results": "mx.example.net; spf=pass smtp.mailfrom=s@sendgrid.net; dkim=pass header.d=sendgrid.net"}
    assert "composite.unauthenticatedFromSpoof" in keys(spark, suffixes, spoof)[0]
    only_id = {"from": "V <victim@example.com>", "message-id": "<a@sendgrid.net>"}
    assert "composite.unauthenticatedFromSpoof" not in keys(spark, suffixes, only_id)[0]
    same_family = {"from": "user@outlook.com", "return-path": "<b@bounce.mail.outlook.com>",
                   "authentication-results": "mx.example.net; dmarc=fail; spf=fail"}
    assert "composite.publicDomainSpoofing" not in keys(spark, suffixes, same_family)[0]
    other = {**same_family, "return-path": "<b@bounce.mail.icloud.com>"}
    assert "composite.publicDomainSpoofing" in keys(spark, suffixes, other)[0]


def test_brand_rule_guards(spark, suffixes):
    def fires(name, address):
        return "composite.brandDivergencePhishing" in keys(spark, suffixes, {"from": f"{name} <{address}>"})[0]
    assert fires("PayPal", "x@secure-login.net")
    assert not fires("PayPal", "x@mail.paypal.com")
    assert not fires("Amazon", "x@amazon.co.jp")
    assert fires("Amazon", "x@amazon.io")
    assert fires("Amazon Support", "x@shop.com")
    assert not fires("Apple Martin", "x@shop.com")


def test_later_filters_do_not_copy_the_rules(spark, suffixes):
    df = score_messages(mail(spark, {"from": "a@example.com"}), TRUST, suffixes).where("score >= 0 AND classification = 'normal'")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(concat(flatten(transform(auth") <= 1 and df.count() == 1


def test_rescoring_keeps_sender_rules(spark, suffixes):
    s = TRUST.with_(sender_rules=(("example.com", "exact", 7.0),))
    m = mail(spark, {"from": "a@example.com", "authentication-results": "mx.example.net; spf=fail"})
    log = H.log_entries(assess(m, s, suffixes), F.current_timestamp(), s)
    row = H.rescore(log, Settings(auth_scores={"spf": {"fail": 1}})).first()
    assert (row["original_score"], row["current_score"]) == (57.0, 8.0)
    assert [d["key"] for d in row["reason_diffs"]] == ["auth.spf.fail"]


def test_logged_servers_bound(spark, suffixes):
    ars = [f"s{i}.test; spf=pass" for i in range(6)] + ["mx.example.net; spf=pass"]
    row = assess(mail(spark, {"from": "a@b.com", "authentication-results": ars}), TRUST, suffixes) \
        .select(H.logged_servers(F.col("auth")).alias("s")).first()["s"]
    assert row["ids"] == ["mx.example.net", "s0.test", "s1.test", "s2.test", "s3.test"] and row["truncated"]


def test_formulas_are_isolated(spark, suffixes):
    s = TRUST.with_(formulas=(("big", "", "base_score + 500", "add"), ("bad", "", "reflect('java.lang.System', 'exit')", "add"),
                              ("null", "", "try_divide(1, 0)", "add"), ("seen", "See", "5", "observe")))
    row = score_messages(mail(spark, {"from": "a@b.com"}), s, suffixes).first()
    d = {x["id"]: x for x in row["formula_diagnostics"]}
    assert row["score"] == 100.0 and d["big"]["applied"] and d["big"]["value"] == 100.0
    assert "not allowed" in d["bad"]["error"] and d["null"]["error"] and not d["seen"]["applied"]
    assert d["seen"]["would_change_score"] == 5.0 and d["big"]["would_change_verdict"] == "normal -> high-risk"


def test_formula_checks():
    for text, mode in (("match(from_.domain, 'x')", "add"), ("1 / 0", "observe"), ("(select 1)", "observe"),
                       ("1; 2", "observe"), ("match(from_.domain, concat('a', 'b'))", "observe"), ("match(from_.domain, '(')", "observe")):
        try:
            check_formula(text, mode)
        except FormulaError:
            continue
        raise AssertionError(text)
    check_formula("CASE WHEN has('x') AND from_.subdomain_depth IN (1, 2) THEN 1 ELSE 0 END", "add")


def test_run_totals_add_up(spark):
    requested = spark.createDataFrame([(i, v) for i, v in enumerate([5, 5, -1, 7, 9, 9, 11])], "pos bigint, msg_id bigint")
    m = spark.createDataFrame([(5, {"from": ["a"]}), (7, None)], "msg_id bigint, headers map<string,array<string>>")
    out = RP.run_outcomes(RP.tag_requests(requested, 3), m)
    assert [r["outcome"] for r in out.orderBy("pos").collect()] == [
        "analysed", "duplicate", "invalid-id", "read-failed", "not-found", "duplicate", "over-limit"]
    t = RP.run_state(RP.run_totals(out)).first()
    assert t["requested"] == t["analysed"] + t["failed"] + t["skipped"] + t["over_limit"] == 7 and t["state"] == "partial"


def test_date_scope_errors(spark):
    import pytest
    m = spark.createDataFrame([(1, None)], "msg_id bigint, sent_at timestamp")
    for start, through, error in (("2026-02-30", "", "invalid-from"), ("", "x", "invalid-through"), ("2026-03-02", "2026-03-01", "inverted")):
        with pytest.raises(RP.ScopeError, match=error):
            RP.scope_by_date(m, start, through)
    assert RP.scope_by_date(m).count() == 1 and RP.scope_by_date(m, "2026-01-01").count() == 0


def test_limits():
    import pytest
    assert RP.resolve_limit() is None and RP.resolve_limit(None, 10) is None and RP.resolve_limit(7, 10) == 7
    for bad in (0, 10001, 1.5, True):
        with pytest.raises(ValueError):
            RP.resolve_limit(bad, 10000)
