"""Jobs compute the groups of facts they read, and no more."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["pass_alignment", "header_facts", "exact_alignment", "message_id_facts", "newest_per_account", "retained_log", "protection_status",
                                  "protection_summary", "export_verdicts", "rule_own_domain_auth_fail"])
def test_no_python_and_no_scoring(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan
    assert name.startswith("rule_") or "heuristic.random" not in plan


def test_unknown_group(spark, suffixes):
    from conftest import mail

    from headrisk.operators.facts import with_facts
    from headrisk.settings import Settings
    with pytest.raises(ValueError, match="unknown groups"):
        with_facts(mail(spark, {}), Settings(), suffixes, ("header",))


def test_long_hosts_are_resolved_whole(spark, suffixes):
    from conftest import mail

    from headrisk.operators.facts import with_facts
    from headrisk.settings import Settings
    host = ".".join(["abcdefghij"] * 22) + ".example.com"
    facts = with_facts(mail(spark, {"from": "a@example.com", "reply-to": f"b@{host}"}), Settings(), suffixes, ("headers",)).first()["header_facts"]
    assert facts["reply_to_registrable_domain"] == "example.com" and len(facts["reply_to_domain"]) == 200
