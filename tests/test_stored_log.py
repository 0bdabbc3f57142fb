"""The stored log, lookups by Message-ID, and newest rows of hot keys."""

import random

import pytest
from conftest import mail
from pyspark.sql import functions as F

from headrisk.operators import history as H
from headrisk.operators import lookups as L
from headrisk.operators import rules as R
from headrisk.operators.scoring import assess
from headrisk.settings import Settings
from headrisk.sources.mail import stream_messages
from headrisk.streaming import jobs as J

TRUST = Settings(trusted_servers=(("mx.example.net", "exact"),))


def test_replayed_batch_adds_nothing(spark, suffixes, tmp_path):
    """A stream writes full entries; its last batch again, as after a lost executor, changes nothing."""
    folder = tmp_path / "mail"
    for i in range(3):
        rows = mail(spark, {"from": f"a{i}@b.com", "authentication-results": "MX.example.net; spf=fail"}, {"from": "x"}).withColumn("msg_id", F.col("msg_id") + 2 * i)
        rows.withColumn("received_at", F.lit(f"2024-01-0{i + 1} 10:00:00").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(folder))
    schema_mail = stream_messages(spark, str(folder), files_per_trigger=1)
    entries = lambda m: H.full_log_entries(assess(m, TRUST, suffixes), F.col("received_at"), F.lit("classified-normal"))
    write, seen = J.log_sink(str(tmp_path / "log"), "s"), {}

    def twice(batch, batch_id):
        kept = batch.persist()
        write(kept, batch_id)
        write(kept, batch_id)
        seen[batch_id] = kept.count()
        kept.unpersist()
    query = entries(schema_mail).writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    log = J.read_log_sink(spark, str(tmp_path / "log"))
    assert len(seen) == 3 and sorted(r.msg_id for r in log.collect()) == list(range(6))
    row = log.where("msg_id = 0").first()
    assert (row.authserv_id, row.trusted, row.action, row.subject, str(row.assessed_on)) == ("MX.example.net", True, "classified-normal", "Hello", "2024-01-01")
    assert {"heuristic_metrics", "display_name_metrics", "alignment_metrics", "message_id_metrics", "header_metrics", "from_parse_metrics", "message_identity",
            "sender_identity", "formula_diagnostics", "score_reasons"} <= set(log.columns)
    assert log.where("msg_id = 1").first().trusted is None
    kept = J.compact_log(spark, str(tmp_path / "log"), str(tmp_path / "small"), 2)
    assert sorted(r.msg_id for r in kept.collect()) == [4, 5] and log.count() == 6


def test_shared_id_costs_a_row_per_entry(spark):
    log = spark.createDataFrame([(i, f"a{i % 30}", "<same@x>") for i in range(300)] + [(900, "a1", "<only@x>"), (901, "zz", None)], "msg_id long, account_id string, rfc_message_id string")
    box = spark.createDataFrame([(1000 + i, "same@x" if i % 2 else "<same@x>", f"a{i % 25}", "f", "n", "t", False) for i in range(500)],
                                "msg_id long, header_message_id string, account_id string, folder_id string, folder_name string, folder_type string, junk boolean")
    got = {r.msg_id: r for r in H.resolve_log(log, box, []).collect()}
    assert len(got) == 302 and not got[900].found and got[901].reason == "no_message_id"
    assert all(got[i].match_count == 500 and got[i].current_account_id == (f"a{i % 30}" if i % 30 < 25 else got[25].current_account_id) for i in range(300))


@pytest.mark.parametrize("n", [1, 7, 5000])
def test_top_n_of_a_hot_key(spark, n):
    pick = random.Random(n)
    rows = [("hot" if i % 3 else pick.choice("abc"), pick.choice([1, 2, None]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, at int, msg_id int")
    got = sorted((r.k, r.rn, r.msg_id) for r in L.top_n(df, ["k"], ["at DESC", "msg_id"], n, F.col("msg_id"), "rn").collect())
    want = []
    for key in "hot", "a", "b", "c":
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        want += [(key, i, r[2]) for i, r in enumerate(mine[:n], 1)]
    assert got == sorted(want)


def test_rule_sets(spark, suffixes):
    own = R.Rule("own.short", "L4", lambda: F.length("from_local") < 3, 9.0, "Short", lambda: {"local": F.col("from_local"), "none": F.lit(None)})
    rules = R.STANDARD.without("composite.alignedAuthenticationConfirmed").with_rule(own)
    m = mail(spark, {"from": "a@b.com", "authentication-results": "mx.example.net; spf=pass smtp.mailfrom=a@b.com; dkim=pass header.d=b.com"}, {"from": "x"})
    plain = [x.key for x in assess(m, TRUST, suffixes).first().score_reasons]
    row = assess(m, TRUST, suffixes, rule_set=rules).first()
    assert "composite.alignedAuthenticationConfirmed" in plain and row.score == 9.0
    assert [x.key for x in row.score_reasons] == [k for k in plain if k != "composite.alignedAuthenticationConfirmed"] + ["own.short"]
    assert row.score_reasons[-1].ctx == {"local": "a"} and row.score_reasons[-1].label == "Short"
    table = rules.table(spark).collect()
    assert table[-1].key == "own.short" and not table[-1].standard and len(table) == len(R.FIXED_KEYS)
    for bad in (lambda: R.STANDARD.without("no.such"), lambda: rules.with_rule(own), lambda: R.Rule("x", "L9", lambda: F.lit(True), 1.0, "x")):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("busy", [100_000, 0])
def test_ids_of_all_kinds_are_resolved_as_by_a_loop(spark, monkeypatch, busy):
    """Shared, repeated and missing ids, entries that come twice, with and without busy ids."""
    monkeypatch.setattr(H, "BUSY_ROWS", busy)
    monkeypatch.setattr(H, "KEY_BUCKETS", 64)
    pick = random.Random(5)
    ids = ["<same@x>", "same@x", *[f"<{i}@x>" for i in range(40)], "", " <7@x> ", None]
    log = [(pick.choice([i, 3, None]) if i % 9 == 0 else i, pick.choice(["a", "b", "c", None]), "<same@x>" if i % 2 else pick.choice(ids)) for i in range(300)]
    box = [(pick.choice([1000 + i, None]) if i % 11 == 0 else 1000 + i, pick.choice(["same@x", "<same@x>", "<7@x>", *[f"{k}@x" for k in range(30)], None]), pick.choice(["a", "b", None])) for i in range(200)]
    got = H.resolve_log(spark.createDataFrame(log, "msg_id long, account_id string, rfc_message_id string"),
                        spark.createDataFrame([(*b, "f", "n", "t", False) for b in box], "msg_id long, header_message_id string, account_id string, folder_id string, folder_name string, folder_type string, junk boolean"), [])
    of: dict = {}
    for m, a, k in log:
        t = (k or "").strip()
        for v, key in enumerate(dict.fromkeys([t, t[1:-1]] if t.startswith("<") else [t]) if t else ()):
            hits = [b for b in box if b[1] == key]
            if not hits:
                continue
            own = [b for b in hits if b[2] == a and a is not None and b[0] is not None]
            best = min((b for b in own or hits if b[0] is not None), default=None, key=lambda b: b[0])
            of.setdefault(m, []).append(((0 if own else 1, v, best[0] if best else -1), best, len(hits)))
    want = []
    for m, a, k in log:
        mine = of.get(m, []) if m is not None else []
        found = [x for x in mine if x[1]]
        want.append((str(m), str(a), str(k), min(found)[1][2] if found else None, sum(x[2] for x in mine) if mine else None, bool(found)))
    assert sorted(want, key=str) == sorted(((str(r.msg_id), str(r.account_id), str(r.rfc_message_id), r.current_account_id, r.match_count, r.found) for r in got.collect()), key=str)


def test_ids_that_are_not_busy_are_not_copied(spark):
    log = spark.range(2000).selectExpr("id AS msg_id", "concat('a', id % 7) AS account_id", "concat('<', id, '@x>') AS rfc_message_id")
    box = spark.range(2000).selectExpr("id AS msg_id", "concat(id, '@x') AS header_message_id", "concat('a', id % 5) AS account_id", "'f' AS folder_id", "'n' AS folder_name", "'t' AS folder_type", "false AS junk")
    df = H.resolve_log(log, box, [])
    assert "_salt" not in df._jdf.queryExecution().optimizedPlan().toString() and df.where("match_count = 1").count() == 2000


@pytest.mark.parametrize("listed,small", [(1000, True), (0, True), (1000, False)])
def test_compaction_ranks_only_owner_time_and_id(spark, tmp_path, monkeypatch, listed, small):
    """Rows that come twice, ties, and owners, times and ids that are null: as many rows of an owner stay as before, and the newest."""
    seen, retain = [], J.retain_latest
    monkeypatch.setattr(J, "retain_latest", lambda log, *a: seen.append(log.columns) or retain(log, *a))
    monkeypatch.setattr(J, "LISTED_FILES", listed)
    monkeypatch.setattr(J, "is_small", lambda df: small)
    pick = random.Random(2)
    rows = [(pick.choice([i, 7, None]), pick.choice(["a", "b", None]), pick.choice([f"2024-0{pick.randrange(1, 9)}-01 10:00:00", None]), f"s{i}") for i in range(200)]
    rows += rows[:60]
    df = spark.createDataFrame(rows, "msg_id long, account_id string, at string, subject string").withColumn("assessed_at", F.col("at").cast("timestamp"))
    write = J.log_sink(str(tmp_path / "log"), "s", "month")
    for batch in (0, 1, 1):
        write(df.where(F.length("subject") % 2 == batch).withColumn("more", F.struct(F.lit(1).alias("x"))), batch)
    got: dict = {}
    kept = J.compact_log(spark, str(tmp_path / "log"), str(tmp_path / "small"), 20, period="month")
    assert set(kept.columns) == {*df.columns, "more", "assessed_on"}
    for r in kept.collect():
        got.setdefault(r.account_id, []).append((r["at"] or "", -1 if r.msg_id is None else r.msg_id))
    for owner in ("a", "b", None):
        mine = sorted(((t or "", -1 if m is None else m) for m, a, t, _s in rows if a == owner), reverse=True)
        assert sorted(got[owner], reverse=True) == mine[:20]
    assert [len(c) for c in seen] == [5]


def test_stored_log_scores_its_messages_once(spark, monkeypatch):
    from headrisk.plans import log_queries as LQ
    taken, sink = [], J.log_sink

    def recorded(*args):
        write = sink(*args)
        return lambda rows, batch: taken.append((batch, rows._jdf.queryExecution().optimizedPlan().toString())) or write(rows, batch)
    monkeypatch.setattr(J, "log_sink", recorded)
    log = LQ.stored_log(spark, "/root/testdata/sf0.001")
    assert [b for b, _ in taken] == [0, 1, 1] and not any("Generate" in p or "Join" in p for _, p in taken)
    assert log.count() == 1500
