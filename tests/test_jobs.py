import json
import os
import random
import uuid
import zlib

import pandas as pd
from conftest import mail
from pyspark.sql import functions as F

from headrisk import constants as C
from headrisk.operators import alerts as AL
from headrisk.operators import protection as P
from headrisk.operators.history import log_entries
from headrisk.operators.scoring import assess
from headrisk.settings import Settings
from headrisk.sources.mail import load_settings, snippets, stream_messages
from headrisk.streaming import jobs

TRUST = Settings(trusted_servers=(("mx.example.net", "exact"),))


def simulate(alerts, interval, queue_max):
    """One owner, every millisecond event in order: arrivals and one timer."""
    shown, queue, last, drain = [], [], None, None

    def tick(now):
        nonlocal queue, last, drain
        while drain is not None and drain <= now:
            entry, queue = queue[0], queue[1:]
            at = drain
            if entry[2]:
                same = [q for q in queue if q[1] == entry[1]]
                queue = [q for q in queue if q[1] != entry[1]]
                shown.append((entry[0], entry[1], at, 1 + sum(q[2] for q in same)))
                last = at
            drain = at + interval if queue else None
    for at, msg, group, ok in sorted(alerts):
        tick(at)
        if last is None or at - last >= interval:
            shown.append((msg, group, at, 1))
            last = at
        else:
            queue = (queue + [(msg, group, ok)])[-queue_max:]
            drain = drain if drain is not None else last + interval
    tick(float("inf"))
    return shown


def test_pacing_matches_simulation(spark):
    rnd = random.Random(3)
    rows, t = [], 0
    for i in range(400):
        t += rnd.choice([1, 5, 20, 90, 1500])
        rows.append((rnd.choice("ab"), t, i, rnd.choice(["x", "y"]), rnd.random() < .8))
    df = spark.createDataFrame(rows, "owner string, at_ms bigint, msg_id bigint, group_key string, eligible boolean")
    got = sorted(tuple(r) for r in AL.paced_alerts(df, 100, 3).collect())
    want = sorted((o, *s) for o in "ab" for s in simulate([r[1:] for r in rows if r[0] == o], 100, 3))
    assert got == want


def test_pending_matches_simulation(spark):
    rnd = random.Random(5)
    rows = sorted({(rnd.randint(1, 3), rnd.randint(0, 5000)) for _ in range(300)})
    want = []
    for key in (1, 2, 3):
        last = None
        for _k, at in [r for r in rows if r[0] == key]:
            if last is None or at >= last + 40:
                want.append((key, at))
                last = at
    df = spark.createDataFrame(rows, "msg_id bigint, at_ms bigint")
    assert sorted(tuple(r) for r in AL.pending_alerts(df, 40).collect()) == sorted(want)


def test_score_stream_equals_batch(spark, suffixes, tmp_path):
    m = mail(spark, {"from": "PayPal <x@secure-login.net>", "authentication-results": "mx.example.net; spf=fail"}, {"from": "a@b.com"})
    m = m.selectExpr("msg_id", "account_id", "CAST(NULL AS STRING) folder_id", "CAST(NULL AS STRING) folder_name", "CAST(NULL AS STRING) folder_path",
                     "CAST(NULL AS STRING) folder_type", "false junk", "timestamp'2026-01-02' sent_at", "timestamp'2026-01-02' received_at", "subject", "headers")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    m.write.parquet(src)
    stream = stream_messages(spark, src)
    checkpoint = jobs.checkpoint_dir(spark, f"score-{uuid.uuid4()}", str(tmp_path / "progress"))
    jobs.score_stream(stream, out, checkpoint, TRUST, suffixes).awaitTermination(120)
    want = log_entries(assess(m, TRUST, suffixes), F.col("received_at"), TRUST)
    pick = lambda d: sorted((r["msg_id"], r["score"], r["classification"]) for r in d.collect())
    assert pick(spark.read.parquet(out)) == pick(want) and len(pick(want)) == 2


def test_delayed_alerts_stream(spark, tmp_path):
    ev = [(1, 0, "alert", None), (2, 0, "alert", None), (2, 1, "moved", "junk"), (3, 1, "alert", None), (3, 2, "moved", "inbox"), (9, 100, "alert", None)]
    src = str(tmp_path / "ev")
    spark.createDataFrame([(k, pd.Timestamp(1000 + s, unit="s").to_pydatetime(), kind, False, f) for k, s, kind, f in ev],
                          "msg_id bigint, at timestamp, kind string, junk boolean, folder_type string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("msg_id bigint, at timestamp, kind string, junk boolean, folder_type string").parquet(src)
    q = (jobs.delayed_alerts(stream, 3000).writeStream.format("parquet").option("path", str(tmp_path / "o"))
         .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {(r["msg_id"], r["shown_at"]) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {(1, 1_003_000), (3, 1_004_000)}


def streamed(spark, tmp_path, rows, ddl, job, name):
    """Rows of a streaming job that gets each list of rows as a micro-batch of its own."""
    src = tmp_path / f"{name}-in"
    src.mkdir()
    for i, part in enumerate(rows):
        spark.createDataFrame(part, ddl).coalesce(1).write.parquet(str(tmp_path / f"{name}-{i}"))
        file = next((tmp_path / f"{name}-{i}").glob("part-*.parquet"))
        file.rename(src / f"{i}.parquet")
        os.utime(src / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = (job(stream).writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out"))
         .option("checkpointLocation", str(tmp_path / f"{name}-progress")).trigger(availableNow=True).start())
    assert q.awaitTermination(240) and q.exception() is None
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / f"{name}-out")).collect())


def splits(events, at, late):
    """The events in one batch, in four batches, and in four whose events come out of order by up to ``late`` seconds."""
    by_time, mixed = sorted(events, key=at), sorted(events, key=lambda e: (at(e) + zlib.crc32(repr(e).encode()) % late, repr(e)))
    return [[by_time], [by_time[25 * i:25 * i + 25] for i in range(4)], [mixed[25 * i:25 * i + 25] for i in range(4)]]


def test_delayed_alerts_do_not_depend_on_batches(spark, tmp_path):
    rnd = random.Random(8)
    kinds = [("alert", None), ("alert", None), ("moved", "junk"), ("moved", "inbox"), ("deleted", None)]
    events = [(rnd.randint(1, 4), rnd.randint(0, 300), *rnd.choice(kinds)) for _ in range(100)]
    delay, keep = 4000, 15_000
    twin = spark.createDataFrame([(k, 1000 * s, kind, False, f) for k, s, kind, f in events], "msg_id bigint, at_ms bigint, kind string, junk boolean, folder_type string")
    want = []
    for key in range(1, 5):
        wait = None
        own = sorted((s, kind == "alert", kind == "deleted" or f == "junk") for k, s, kind, f in events if k == key)
        for s, is_alert, _gone in own:
            if is_alert and (wait is None or s >= wait + 4):
                wait = s
                places = [(t, g) for t, a, g in own if not a and s + 4 - 15 <= t < s + 4]
                if not (places and max(places)[1]):
                    want.append((key, 1000 * s, 1000 * s + delay))
    want.sort()
    assert sorted(tuple(r) for r in AL.settled_alerts(twin, delay, keep).collect()) == want and 10 < len(want) < 40
    ddl = "msg_id bigint, at timestamp, kind string, junk boolean, folder_type string"
    stamp = lambda e: (e[0], pd.Timestamp(e[1], unit="s").to_pydatetime(), e[2], False, e[3])
    for n, parts in enumerate(splits(events, lambda e: e[1], 20)):
        rows = [[stamp(e) for e in part] for part in [*parts, [(99, 5000, "moved", None)]]]
        got = streamed(spark, tmp_path, rows, ddl, lambda s: jobs.delayed_alerts(s, delay, "60 seconds", keep), f"d{n}")
        assert got == want, n


def test_dedup_alerts_equals_its_batch_form(spark, tmp_path):
    stamp = lambda k, s: (k, pd.Timestamp(s, unit="s").to_pydatetime())
    batches = [[stamp(1, 100), stamp(1, 102), stamp(2, 101)], [stamp(1, 102), stamp(2, 103)], [stamp(3, 120)], [stamp(1, 121), stamp(1, 122), stamp(3, 122)], [stamp(99, 5000)]]
    ddl, job = "msg_id bigint, assessed_at timestamp", lambda s: jobs.dedup_alerts(s, 5000, "60 seconds")
    got = streamed(spark, tmp_path, batches, ddl, job, "u")
    assert got == [(1, 100_000), (1, 121_000), (2, 101_000), (3, 120_000)]
    rnd = random.Random(12)
    requests = [(rnd.randint(1, 4), rnd.randint(0, 300)) for _ in range(100)]
    batch = spark.createDataFrame([(k, 1000 * s) for k, s in requests], "msg_id bigint, at_ms bigint")
    want = sorted(tuple(r) for r in AL.pending_alerts(batch, 5000).collect())
    for n, parts in enumerate(splits(requests, lambda r: r[1], 20)[1:]):
        assert streamed(spark, tmp_path, [[stamp(*r) for r in part] for part in [*parts, [(99, 5000)]]], ddl, job, f"u{n}") == want


def test_paced_stream_equals_its_batch_form(spark, tmp_path):
    rnd = random.Random(9)
    alerts = [(f"o{rnd.randint(1, 3)}", i, rnd.randint(0, 300), rnd.choice("ab"), rnd.random() < 0.8) for i in range(100)]
    batch = spark.createDataFrame([(o, 1000 * s, i, g, e) for o, i, s, g, e in alerts], "owner string, at_ms bigint, msg_id bigint, group_key string, eligible boolean")
    want = sorted(tuple(r) for r in AL.paced_alerts(batch, 9000, 3).collect())
    assert len(want) > 30
    ddl = "owner string, at timestamp, msg_id bigint, group_key string, eligible boolean"
    stamp = lambda a: (a[0], pd.Timestamp(a[2], unit="s").to_pydatetime(), a[1], a[3], a[4])
    for n, parts in enumerate(splits(alerts, lambda a: a[2], 20)):
        rows = [[stamp(a) for a in part] for part in [*parts, [("end", 1000, 5000, "a", True)]]]
        got = streamed(spark, tmp_path, rows, ddl, lambda s: jobs.paced_stream(s, 9000, 3, "60 seconds"), f"p{n}")
        assert [r for r in got if r[0] != "end"] == want, n


def test_settings_document(spark, tmp_path):
    doc = {"trustedDomains": ["old.example.com"], "senderDomainRules": [{"domain": "a.com", "matchType": "exact", "score": 3}],
           "settings": {"heuristicScores": {"randomFromDomainLabel": 30, "randomFromLocalPart": 10, "layer3Cap": 40},
                        "layer2Scores": {"dkimDomainMismatch": 9}, "authScores": {"spf": {"fail": 77}}, "moveToReview": False}}
    path = tmp_path / "s.json"
    path.write_text(json.dumps(doc))
    s = load_settings(spark, str(path))
    assert s.trusted_servers == (("old.example.com", "exact"),) and s.sender_rules == (("a.com", "exact", 3.0),)
    assert s.heuristic("randomFromDomainLabel") == C.HEURISTIC_SCORES["randomFromDomainLabel"]  # earlier defaults are replaced
    assert s.identity("dkimDomainMismatch") == 9 and s.auth_scores["spf"]["fail"] == 77 and s.auth_scores["spf"]["none"] == 15
    assert s.move_to_review is False and s.alert_max_score == 49


def test_snippet_order_and_cut(spark):
    parts = spark.createDataFrame([(1, "0.10", "text/plain", "late"), (1, "0.2", "TEXT/PLAIN; x", " a \n b "), (1, "0.1", "text/html", "h"),
                                   (1, "0.0", "text/plain", "  "), (2, "0", "text/plain", "x" * 161)], "msg_id bigint, path string, content_type string, body string")
    got = {r["msg_id"]: r["snippet"] for r in snippets(parts).collect()}
    assert got == {1: "a b", 2: "x" * 160 + "…"}


def test_setup_checklist(spark, suffixes):
    ids = spark.createDataFrame([("a", 0, "me@shop.com")], "account_id string, pos bigint, email string")
    choices = spark.createDataFrame([("a", "mx.shop.com")], "account_id string, host string")
    log = spark.createDataFrame([(1, "a", 1, ["mx.example.net"], False), (2, "a", 2, ["mx.shop.com"], False)],
                                "msg_id bigint, account_id string, assessed_at bigint, authserv_ids array<string>, authserv_ids_truncated boolean")
    mx = spark.createDataFrame([("shop.com", "in.shop.com", 10)], "domain string, exchange string, priority int")
    sug = P.setup_suggestions(ids, mx)
    got = P.check_setup(choices, P.setup_accounts(ids), sug, TRUST, P.account_mail(log, TRUST, choices), suffixes)
    assert [(r["key"], r["level"]) for r in got.orderBy("item_order").collect()] == [
        ("account_domains", "ok"), ("mail_summary", "ok"), ("host_matches_hint", "ok"), ("host_seen", "info")]


def test_formula_reads_no_table():
    import pytest

    from headrisk.operators.formulas import FormulaError, check_formula

    for text in ("try_cast('1' AS INT) + (SELECT x FROM secret LIMIT 1)", "if(exists(SELECT 1), 1, 0)", "base_score + (TABLE secret)"):
        with pytest.raises(FormulaError):
            check_formula(text, "add")
    check_formula("try_cast(from_.subdomain_depth AS DOUBLE) + 1", "add")


def test_two_hosts_of_one_account_do_not_double_its_mail(spark):
    from headrisk.operators import protection as P

    log = spark.createDataFrame([("a", 1, 5, ["mx.one.net"], False)], "account_id string, msg_id long, at_ms long, authserv_ids array<string>, authserv_ids_truncated boolean")
    log = log.withColumn("assessed_at", F.timestamp_millis("at_ms"))
    hosts = spark.createDataFrame([("a", "MX.one.net"), ("a", "other.net")], "account_id string, host string")
    got = sorted((r.host, r.total, r.host_seen) for r in P.account_mail(log, TRUST, hosts).collect())
    assert got == [("mx.one.net", 1, 1), ("other.net", 1, 0)]


def test_message_ids_are_whole_numbers(spark):
    from headrisk.operators import report as RP

    asked = spark.createDataFrame([(1, 1.5), (2, 2.0), (3, -1.0), (4, None)], "pos long, msg_id double")
    assert {r.pos: r.outcome for r in RP.tag_requests(asked, None).collect()} == {1: "invalid-id", 2: "kept", 3: "invalid-id", 4: "invalid-id"}
