"""Settings of many accounts in one run, and lists too long to stand in a plan."""

import json

import pytest
from conftest import mail
from pyspark.sql import functions as F

from headrisk import settings as SE
from headrisk.operators import lookups as L
from headrisk.operators import owners as OW
from headrisk.operators.scoring import assess
from headrisk.settings import Settings
from headrisk.sources.mail import load_owner_settings, load_settings

MAIL = [
    {"from": "a <a@x.bulk.net>", "message-id": "<1@x.bulk.net>", "authentication-results": ["MX.example.net; spf=fail smtp.mailfrom=a@x.bulk.net", "gw.trusted.org 1; dkim=pass header.d=bulk.net"]},
    {"from": "Friend@Partner.com", "message-id": "<2@partner.com>", "authentication-results": "a.gw.trusted.org (c); dmarc=fail"},
    {"from": "x <q@other.org>", "authentication-results": ['"mx.example.net"; spf=pass', "trusted.org.evil.test; spf=fail"]},
    {"from": "undisclosed"}, {},
]
FULL = Settings(trusted_servers=(("mx.example.net", "exact"), ("Trusted.org", "domain")), whitelist=(("Friend@partner.com", "exact"), ("friend@Partner.com", "exact")),
                sender_rules=(("Bulk.net", "suffix", 20.0), ("x.bulk.net", "exact", 5), ("ulk.net", "suffix", 9.0), ("net", "suffix", 1.0), ("other.org", "other", 3.0)))


def reasons(df):
    return {r.msg_id: [(x.key, x.delta, x.ctx) for x in r.score_reasons] + [r.score] for r in df.select("msg_id", "score_reasons", "score").collect()}


def test_long_lists_give_the_same(spark, suffixes, monkeypatch):
    short = reasons(assess(mail(spark, *MAIL), FULL, suffixes))
    assert any(k == "sender.rule" for k, *_ in short[0][:-1]) and any(k == "whitelist.manual" for k, *_ in short[1][:-1])
    monkeypatch.setattr(SE, "LITERAL_MAX", 1)
    assert reasons(assess(mail(spark, *MAIL), FULL, suffixes)) == short


def test_many_rules_are_not_in_the_plan(spark, suffixes):
    many = FULL.with_(sender_rules=FULL.sender_rules + tuple((f"shop{i}.example", "suffix", 1.0) for i in range(100_000)))
    df = assess(mail(spark, *MAIL), many, suffixes)
    assert "shop77777" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert reasons(df) == reasons(assess(mail(spark, *MAIL), FULL, suffixes))


def test_owner_without_settings_has_the_defaults(spark, suffixes):
    rows = lambda schema: spark.createDataFrame([], schema)
    tables = OW.OwnerTables(OW.owner_parameters(rows("account_id string, group string, key string, weight double")),
                            rows("account_id string, value string, match_type string"), rows("account_id string, pos int, value string, match_type string"),
                            rows("account_id string, pos int, domain string, match_type string, score double"))
    assert reasons(OW.assess_by_owner(mail(spark, *MAIL), tables, suffixes)) == reasons(assess(mail(spark, *MAIL), Settings(), suffixes))


@pytest.fixture
def documents(tmp_path):
    base = {"trustedDomains": ["mx.example.net", {"value": "trusted.org", "matchType": "domain"}], "manualWhitelist": [{"value": "friend@partner.com", "matchType": "exact"}],
            "senderDomainRules": [{"domain": "bulk.net", "matchType": "suffix", "score": 7}]}
    one = base | {"settings": {"authScores": {"spf": {"fail": 33, "odd": 4}}, "compositeScores": {"ownDomainAuthFail": 1}, "whitelistMitigationScore": -8}}
    old = {"trustedDomains": ["mx.example.net"], "settings": {"heuristicScores": {"randomFromDomainLabel": 30, "randomFromLocalPart": 10, "layer3Cap": 40}, "scoreDefaultsVersion": "v0.3.3"}}
    for name, doc in (("one.json", one), ("two.json", old), ("three.json", {})):
        (tmp_path / name).write_text(json.dumps(doc))
    return tmp_path


def test_all_documents_are_loaded(spark, suffixes, documents):
    """Every account is scored as by a run of its own."""
    owners = load_owner_settings(spark, str(documents))
    names = ["one", "two", "three", "nobody"]
    own = {n: load_settings(spark, str(documents / f"{n}.json")) if n != "nobody" else Settings() for n in names}
    all_mail = mail(spark, *MAIL).drop("account_id").withColumn("account_id", F.explode(F.array(*map(F.lit, names))))
    got: dict = {n: {} for n in names}
    for r in OW.assess_by_owner(all_mail, owners, suffixes).select("account_id", "msg_id", "score_reasons", "score").collect():
        got[r.account_id][r.msg_id] = [(x.key, x.delta, x.ctx) for x in r.score_reasons] + [r.score]
    for name in ("one", "two"):
        assert got[name] == reasons(assess(mail(spark, *MAIL), own[name], suffixes)), name
    assert got["three"] == got["nobody"] and got["one"][0][-1] != got["two"][0][-1]
    with pytest.raises(ValueError, match="several"):
        load_settings(spark, str(documents))


def test_rules_in_order_and_of_the_own_account(spark):
    hosts = spark.createDataFrame([("a", "x.y.com"), ("b", "x.y.com"), ("a", "com"), ("a", ""), ("a", None)], "account_id string, host string")
    rules = spark.createDataFrame([("a", 2, "Y.com", "suffix", 2.0), ("a", 1, "com", "suffix", 1.0), ("a", 3, "y.com", "exact", 3.0), ("b", 0, "x.y.com", "exact", 4.0),
                                   ("a", 4, "x.y.com", "suffix", 5.0), ("a", 5, None, "suffix", 6.0), ("a", 6, "y.com", None, 6.0)],
                                  "account_id string, pos int, domain string, match_type string, score double")
    got = {(r.account_id, r.host): [h.score for h in r.sender_hits] for r in L.suffix_matches(hosts, rules).collect()}
    assert got == {("a", "x.y.com"): [1.0, 2.0, 5.0], ("a", "com"): [1.0], ("b", "x.y.com"): [4.0]}


RULES_OF = ("account_id string, value string, match_type string", "account_id string, pos int, value string, match_type string",
            "account_id string, pos int, domain string, match_type string, score double")


def some_owners(spark):
    trust = [("a", "MX.example.net", "exact"), ("a", "Trusted.org", "domain"), ("a", "trusted.org", "domain"), ("b", "unknown.test", "domain"), ("b", "", "domain"), (None, "mx.example.net", "exact"),
             ("b", None, "exact"), ("c", "mx.example.net", "other")]
    white = [("a", 1, "Friend@Partner.com", "exact"), ("a", 0, "friend@partner.com", "exact"), ("b", 0, "Friend@Partner.com", "suffix"), (None, 0, "friend@partner.com", "exact"), ("c", 0, None, "exact")]
    send = [("a", 2, "Bulk.net", "suffix", 20.0), ("a", 1, "x.bulk.net", "exact", 5.0), ("a", 3, "ulk.net", "suffix", 9.0), ("a", 1, "x.bulk.net", "exact", 5.0), ("b", 0, ".net", "suffix", 1.0),
            ("b", None, "net", "suffix", 2.0), ("b", 4, "", "suffix", 3.0), ("b", 5, None, "suffix", 3.0), (None, 0, "net", "suffix", 7.0), ("c", 0, "other.org", None, 4.0)]
    return OW.OwnerTables(OW.owner_parameters(spark.createDataFrame([("a", "auth", "spf.fail", 31.0)], "account_id string, group string, key string, weight double")),
                          *[spark.createDataFrame(rows, schema) for rows, schema in zip((trust, white, send), RULES_OF)])


def test_short_lists_give_what_joined_ones_give(spark, suffixes, monkeypatch):
    odd = [*MAIL, {"from": "x <a@b..net>", "authentication-results": ["a.; spf=fail", "; dkim=fail", "mail.unknown.test; spf=fail"]}]
    accounts = F.explode(F.array(*[F.lit(a) for a in ("a", "b", "c", None)]))
    box = mail(spark, *odd, *odd).drop("account_id").withColumn("account_id", accounts)
    give = lambda: sorted((str(r.account_id), r.msg_id, sorted(r.trusted_ids), r.whitelist_hit, [tuple(h) for h in r.sender_hits])
                          for r in hits(L.with_trusted_ids(box, some_owners(spark).trusted)).select("account_id", "msg_id", "trusted_ids", "whitelist_hit", "sender_hits").collect())

    def hits(rows):
        host = F.get("headers.from", F.lit(0))
        rows = rows.withColumn("from_domain", F.regexp_extract(host, "@([^>]*)", 1)).withColumn("sender_address", F.lower(host))
        return L.with_sender_hits(L.with_whitelist_hit(rows, some_owners(spark).whitelist), some_owners(spark).sender_rules)
    short = give()
    assert any(r[2] for r in short) and {r[3] for r in short} == {None, "friend@partner.com"} and any(len(r[4]) == 3 for r in short)
    for bound, value in (("OWNER_LIST_MAX", 0), ("SMALL_ROWS", 1), ("SMALL_TEXT", 10)):
        with monkeypatch.context() as m:
            m.setattr(L, bound, value)
            assert give() == short, bound


def test_settings_of_accounts_do_not_move_the_messages(spark, suffixes):
    """Short lists are broadcast: messages are not dealt to tasks by account, address or host."""
    box = mail(spark, *MAIL).withColumn("account_id", F.lit("a"))
    scored = OW.assess_by_owner(box, some_owners(spark), suffixes).select("msg_id", "score")
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in plan
