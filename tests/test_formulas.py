"""Formulas that cannot be used leave a diagnostic; the others still score."""

import pytest
from conftest import mail

from headrisk.operators import formulas as FX
from headrisk.operators.scoring import score_messages
from headrisk.settings import Settings

TRUST = Settings(trusted_servers=(("mx.example.net", "exact"),))
GOOD = {"1": 1.0, "base_score + 2.5": 2.5, "length(from_.domain) * 2147483647": 100.0, "round(10 / 1, 1)": None, "round(try_divide(length(from_.domain), 7), 2)": 0.71,
        "floor(-0.5)": -1.0, "ceil(0.2) + scoreOf('none')": 1.0, "clamp(5, 0, 3)": 3.0, "min(4, 2) + max(1, from_.subdomain_depth)": 3.0,
        "CASE WHEN from_.subdomain_depth IN (0, 1) THEN 4 ELSE 0 END": 4.0, "CASE WHEN from_.domain = 'b.com' THEN 7 END": 7.0, "try_cast('12' AS DOUBLE)": 12.0,
        "CASE WHEN match(from_.domain, '^B\\\\.', 'i') THEN 6 ELSE 0 END": 6.0, "if(nameContains('al'), 1, 2)": 1.0, "if(has('x'), 1, 2)": 2.0, "1e1 + 2": 12.0,
        "if('1 2' = '1 2', 3, 0)": 3.0, "coalesce(try_divide(1, 0), 9)": 9.0}
BAD = {"from_.domain + 1": "types do not match", "if(from_.domain = 5, 1, 0)": "types do not match", "verdict": "finite", "1 +": "", "1e999": "", "sqrt(-1)": "finite",
       "base_score + (TABLE secret)": "only expressions", "if(1 IN (SELECT 1), 1, 0)": "only expressions", "nothing + 1": "", "length(5)": "types do not match",
       "if(match(from_.domain, '(?P<n>a)'), 1, 0)": "match()", "if(alignment.spf_aligned = 'true', 1, 0)": "types do not match", "try_cast('1' AS INT) + 1": "try_cast",
       "CASE WHEN true THEN 1 ELSE 'a' END": "", "1 / 2": "try_divide", "reflect('a', 'b')": "not allowed"}


def test_good_and_bad_formulas(spark, suffixes):
    texts = [t for t in [*GOOD, *BAD] if GOOD.get(t, 0) is not None]
    found = {}
    for i in range(0, len(texts), 20):
        some = texts[i: i + 20]
        s = TRUST.with_(formulas=tuple((f"f{k}", "", t, "observe") for k, t in enumerate(some)))
        row = score_messages(mail(spark, {"from": "Al <a@b.com>"}), s, suffixes).first()
        found |= {t: d for t, d in zip(some, row["formula_diagnostics"])}
    for text, value in GOOD.items():
        if value is not None:
            assert (found[text]["value"], found[text]["error"]) == (value, None), text
    for text, error in BAD.items():
        assert found[text]["value"] is None and error in found[text]["error"], (text, found[text]["error"])


def test_formulas_past_the_limit_are_reported(spark, suffixes):
    s = TRUST.with_(formulas=tuple((f"f{i}", "", "1", "add") for i in range(22)))
    row = score_messages(mail(spark, {"from": "a@b.com"}), s, suffixes).first()
    assert row["score"] == 20.0 and [d["error"] for d in row["formula_diagnostics"]] == [None] * 20 + [FX.OVER_LIMIT] * 2


def test_context_has_the_promised_types(spark, suffixes):
    from headrisk.operators.scoring import assess
    context = FX.formula_context(assess(mail(spark, {"from": "a@b.com"}), TRUST, suffixes)).select("ctx.*")
    plain = lambda df: [(f.name, f.dataType.simpleString()) for f in df.schema]
    assert plain(context) == plain(FX.empty_context(spark))


@pytest.mark.parametrize("text", ["with.x + 1", "over + table"])
def test_names_are_not_keywords(text):
    FX.check_formula(text, "add")


def test_formulas_and_score_are_computed_once_a_row(spark, suffixes):
    from conftest import mail

    from headrisk.operators import scoring as S
    from headrisk.settings import Settings
    settings = Settings(formulas=(("a", "", "length(from_.domain) * 7919", "add"), ("b", "", "base_score + 1", "add")))
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = S.assess(mail(spark, {"from": "a@example.com"}), settings, suffixes)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("7919") == 1
