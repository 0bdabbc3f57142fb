"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from headrisk.llm import op13, spelling

SCHEMA = "doc_id long, text string, word string, n string, cell string"


def rows() -> list[tuple]:
    pick = random.Random(4)
    stems = ["".join(pick.choice("abcdeéßstr") for _ in range(pick.randint(7, 11))) for _ in range(60)]
    words = []
    for w in stems:
        words += [w] * pick.choice([2, 3, 30, 300])
        for _ in range(4):
            k = pick.randrange(len(w))
            words += [pick.choice([w[:k] + w[k + 1:], w[:k] + "x" + w[k:], w[:k] + pick.choice("aeé") + w[k + 1:]])] * pick.choice([1, 2, 3])
    words += ["aaaaaaaaa", "aaaaaaaab"] * 2 + ["step" * 5] * 500 + ["step" * 5 + "s"] * 35 + ["step" * 5 + "sx"] * 3 + ["Ünrelated", "x÷y×zabcd"] * 3
    pick.shuffle(words)
    texts = [pick.choice([" ", "-", "1", "\n"]).join(words[i: i + 40]) for i in range(0, len(words), 40)]
    texts += [None, "", "short words", "l" * 5000 + " " + "l" * 5000, "l" * 4999 + "m " + "l" * 5001, "l" * 5001 + " " + "l" * 4999 + "m", texts[0].upper(), texts[1]]
    return [(None if i == 3 else i, t, "w", "n", "c") for i, t in enumerate(texts)]


def counted(table) -> dict[str, int]:
    count = Counter()
    for i, text, *_ in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(count: dict[str, int]) -> dict[str, tuple]:
    near = {w: [v for v in count if v != w and abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in count}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best and count[best] >= 10 * count[w] else None
    found = {}
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        found[w] = (form[w], root, count[w], len(near[w]), count.get(form[w]))
    return found


@pytest.mark.parametrize("cell_words", [spelling.CELL_WORDS, 12])
def test_variants(spark, tmp_path, monkeypatch, cell_words):
    monkeypatch.setattr(spelling, "CELL_WORDS", cell_words)
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = expected(counted(rows()))
    assert sum(1 for f, r, *_ in want.values() if f and r != f)  # a root two steps away
    got = op13.query(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want


def test_letters_beyond_latin(spark):
    words = [("слово-о", 30), ("слова-о", 2), ("слово-ое", 3), (None, 5), ("", 4), ("другое!", 9)]
    got = {r.word: (r.form, r.n_near) for r in spelling.variants(spark.createDataFrame(words, "word string, n int")).collect()}
    assert got == {"слово-о": (None, 2), "слова-о": ("слово-о", 1), "слово-ое": ("слово-о", 1), "другое!": (None, 0)}


def test_reach_holds_every_edit():
    """A word one edit away lies in a leaf that the search reaches."""
    pick = random.Random(6)
    words = sorted({"".join(pick.choice("abcde") for _ in range(pick.randint(5, 7))) for _ in range(400)})
    x = spelling.vectors(words)
    tree = spelling.Tree(x, 5)
    leaf = np.empty(len(words), int)
    for number, members in enumerate(tree.members):
        leaf[members] = number
    further = np.concatenate([x[:, :1] + spelling._LENGTH, x[:, 1:]], axis=1)
    same, longer = ({(int(r), c) for c, at, _ in tree.reach(y, 1, less) for r in at} for y, less in ((x, 1), (further, 0)))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            if i != j and one_edit(a, b) and len(b) >= len(a):
                assert (i, leaf[j]) in (same if len(a) == len(b) else longer)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert op13.query(spark, str(tmp_path)).collect() == []
