"""Mixing against a plain version that sorts each source by hash."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from headrisk.llm import mixing, op12

SCHEMA = "doc_id long, text string, source string, size string, bound string, hash string, k string, target string"


def rows() -> list[tuple]:
    pick = random.Random(2)
    found = []
    for i in range(400):
        source = pick.choice(["a", "a", "a", "b", "B", "é", None, "", "tiny"]) if i > 4 else "tiny"
        n = pick.choice([0, 1, 5, 40, 900]) if source != "tiny" else 3
        found.append((i, pick.choice([" ", "\t\n", "\x0b "]).join(["wörd"] * n), source))
    found += [found[10]] * 3 + [(None, "two words", "a"), (None, None, None), (7000, None, "only null"), (7001, "　 one", "a"), (7002, "x " * 30000, "b")]
    return [(*r, *["kept"] * 5) for r in found]


def plain(table, weights=(1, 2, 3), most=3) -> tuple[dict, Counter]:
    docs = [(r[0], r[2], len(re.findall("[^\x20\x09-\x0d]+", r[1] or "")),
             int(hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()[:15], 16)) for r in table]
    sizes = Counter()
    for _, s, n, _ in docs:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed: dict = {}
    while True:
        left = sum(weight[s] for s in order if s not in fixed)
        rest = sum(sizes.values()) - sum(fixed.values())
        above = [s for s in order if s not in fixed and rest / left * weight[s] > most * sizes[s]]
        if not above:
            break
        fixed.update((s, most * sizes[s]) for s in above)
    target = {s: fixed.get(s, rest / left * weight[s]) for s in order}
    by_hash = defaultdict(Counter)
    for _, s, n, h in docs:
        by_hash[s][h] += n
    copies = Counter()
    for s in order:
        for k in range(most):
            budget, before = min(max(target[s] - k * sizes[s], 0), sizes[s]), 0
            for h in sorted(by_hash[s]):
                copies[s, h] += 2 * before + by_hash[s][h] <= 2 * budget
                before += by_hash[s][h]
    return target, Counter((i, s, n, sizes[s], round(target[s], 6), n * copies[s, h]) for i, s, n, h in docs)


@pytest.mark.parametrize("few", [mixing.BROADCAST_SOURCES, 2])
def test_mix(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", few)
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    target, want = plain(rows())
    got = [(r.doc_id, r.source, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(docs).collect()]
    assert Counter(got) == want
    taken, largest = Counter(), Counter()
    for i, s, n, _, _, t in got:
        taken[s] += t
        largest[s] = max(largest[s], n)
        assert t <= 3 * n
    assert all(abs(taken[s] - target[s]) <= 3 * largest[s] for s in target)


def test_mixture_keeps_columns(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = mixing.mixture(docs)
    assert got.columns == docs.columns
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r.doc_id, r.source, r["size"]] += r.copies
    found = Counter((r.doc_id, r.source, len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))) for r in got.collect())
    assert {k: n for k, n in copies.items() if n and k[2]} == {k: n for k, n in found.items() if k[2]}
    assert all(set(r[3:]) == {"kept"} for r in got.collect())


def test_no_words_and_empty(spark, tmp_path):
    nothing = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.target, r.taken) for r in mixing.mix(nothing).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op12.query(spark, str(tmp_path)).collect() == []


def test_main_path_is_native(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
