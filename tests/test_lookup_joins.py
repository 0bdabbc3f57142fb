"""Tables that messages are looked up in: messages stay in place, or a busy key is dealt to several tasks."""

import pytest

from headrisk.operators import history as H
from headrisk.operators import lookups as L
from headrisk.operators import scoring as S
from headrisk.settings import Settings


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_identities_of_unknown_size_do_not_move_the_messages(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")  # no estimate is small enough, as with the keys of a large table
    try:
        facts = spark.range(1000).selectExpr("id AS msg_id", "concat('account', id % 2) AS account_id", "IF(id % 5 = 0, NULL, concat('a@', id % 3)) AS sender_address")
        domains = spark.range(100000).selectExpr("concat('account', id % 2) AS account_id").distinct().selectExpr("account_id", "array('x.com') AS account_domains")
        books = spark.range(3).selectExpr("concat('A@', id % 2) AS address")
        joined = S.with_lookups(facts, Settings(address_book_enabled=True), books, domains)
        above = _plan(joined).split("BroadcastHashJoin")[0]
        assert "SortMergeJoin" not in _plan(joined) and "Exchange" not in above
        rows = joined.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(rows) == 1000 and all(r.account_domains == ["x.com"] for r in rows)
    assert all(r.in_address_book == (r.msg_id % 5 != 0 and r.msg_id % 3 < 2) for r in rows)


@pytest.mark.parametrize("bound", ["SMALL_ROWS", "SMALL_TEXT"])
def test_tables_above_the_bound_are_joined_in_parts(spark, monkeypatch, bound):
    left = spark.range(1000).selectExpr("id AS msg_id", "IF(id % 10 < 8, 'hot', IF(id % 10 = 8, NULL, concat('k', id))) AS key")
    right = spark.range(500).selectExpr("IF(id = 0, 'hot', concat('k', id)) AS key", "id AS n")
    small = {tuple(r) for r in L.lookup_join(left, right, ["key"], L.F.col("msg_id")).select("msg_id", "key", "n").collect()}
    monkeypatch.setattr(L, bound, 10)
    large = L.lookup_join(left, right, ["key"], L.F.col("msg_id"))
    assert "_salt" in _plan(large)
    assert {tuple(r) for r in large.select("msg_id", "key", "n").collect()} == small and len(small) == 1000


def test_review_folders_do_not_move_the_messages(spark, monkeypatch):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        messages = spark.range(1000).selectExpr("id AS msg_id", "IF(id % 5 = 0, NULL, concat('account', id % 2)) AS account_id", "'f' AS folder_id", "'Auth Review' AS folder_name",
                                                "IF(id % 3 = 0, 'normal', 'review') AS classification")
        folders = spark.range(100000).selectExpr("concat('account', id % 2 * 2) AS account_id").distinct().selectExpr("account_id", "'g' AS review_folder_id")
        for bound in (L.SMALL_ROWS, 1):
            monkeypatch.setattr(L, "SMALL_ROWS", bound)
            routed, reviewed = S.route(messages, Settings(), folders), H.in_review_folder(messages, folders)
            for joined in (routed, reviewed):
                if bound > 1:
                    assert "SortMergeJoin" not in _plan(joined) and "Exchange" not in _plan(joined).split("BroadcastHashJoin")[0]
                else:
                    assert "_salt" in _plan(joined)
                assert joined.columns[:6] == [*messages.columns, "review_folder_id"]
            has_folder = lambda i: i % 5 != 0 and i % 2 == 0
            assert {r.msg_id: r.action for r in routed.collect()} == {
                i: "classified-normal" if i % 3 == 0 else "move-review" if has_folder(i) else "no-review-folder-configured" for i in range(1000)}
            assert {r.msg_id: r.in_review for r in reviewed.collect()} == {i: not has_folder(i) for i in range(1000)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_scoring_queries_join_nothing_by_moving_the_messages(spark):
    import __spark_entry__ as entry
    names = ("scores_with_own_rules last_formula_results recent_log alert_eligible apply_formulas non_zero_reasons protective_facts reason_context "
             "reason_rows reason_texts rescore route_messages rule_drilldown score_messages top_reasons activity_summary").split()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")  # less than the estimate for the keys of ``orders``, more than the list of scenarios
    try:
        plans = {n: _plan(entry.queries()[n](spark, "/root/testdata/sf0.01")) for n in names}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert [n for n, p in plans.items() if "SortMergeJoin" in p or "Exchange hashpartitioning" in p.split("BroadcastHashJoin")[0]] == []
