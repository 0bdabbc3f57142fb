"""Pages read by the range of their keys."""

import random

import pytest

from headrisk.operators import report as RP


@pytest.mark.parametrize("n,ranges", [(0, 64), (1, 64), (999, 64), (1000, 3), (1001, 1)])
def test_pages_are_whole_and_in_order(spark, monkeypatch, n, ranges):
    monkeypatch.setattr(RP, "INDEX_RANGES", ranges)
    pick = random.Random(n)
    rows = [(pick.choice([None, "a", "b", "é", "z" * 50]), i, "x") for i in range(n)]
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, id int, text string").repartition(4)
    order = ["k", "id"]
    want = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    index = RP.page_index(df, order, 100)
    starts = [(r.page, r.position, r.k, r.id) for r in index.orderBy("page").collect()]
    assert starts == [(i // 100, i + 1, *want[i][:2]) for i in range(0, n, 100)]
    for page in (0, 3, 9, 10, 999):
        at = min(page, max(0, (n - 1) // 100)) * 100
        got = [(r.position, r.k, r.id, r.text) for r in RP.read_page(df, index, order, page).orderBy("position").collect()]
        assert got == [(at + i + 1, *r) for i, r in enumerate(want[at: at + 100])]


def test_a_page_runs_its_source_once(spark):
    ran = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b
    source = spark.range(250, numPartitions=4).mapInArrow(counted, "id bigint")
    got = [(r.id, r.position) for r in RP.page(source, ["id"], 9).orderBy("position").collect()]
    assert got == [(i, i + 1) for i in range(200, 250)] and ran.value == 250


def test_messages_of_a_rule_are_the_folded_matches(spark):
    rows = [(i, 1.0, "normal", [(f"k{j % 3}", f"label {j}", float(j - 2)) for j in range(i % 6)]) for i in range(60)] + [(99, 0.0, "normal", None)]
    scored = spark.createDataFrame(rows, "msg_id int, score double, classification string, score_reasons array<struct<key:string,label:string,delta:double>>")
    for key in ("k0", "k2", "none"):
        got, want = RP.rule_messages(scored, key), RP.matches(scored).where(RP.F.col("key") == key)
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert RP.rule_messages(scored, "k0").count() == 50
