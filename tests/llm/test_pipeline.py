"""The stages against a plain pipeline over the smallest documents table."""

from __future__ import annotations

from collections import Counter

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from headrisk.llm import op1
from test_operators import plain_fingerprint

FOLDER = "/root/testdata/sf0.001"


def plain_run() -> Counter:
    """The number of tokens of each document that is packed."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({op1.SQL}) WHERE kept").fetchall()}
    docs = {i: t for i, t in con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall() if i in kept}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    often = Counter(k for t in docs.values() for k in {key(x) for x in t.split("\n")} if k)
    docs = {i: "\n".join(x for x in t.split("\n") if often[key(x)] < 10) for i, t in docs.items()}
    ids, marks = list(docs), [plain_fingerprint(t) for t in docs.values()]
    group = list(range(len(ids)))
    for a in range(len(ids)):
        for b in range(a):
            if (marks[a] ^ marks[b]).bit_count() <= 4 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    docs = {ids[k]: docs[ids[k]] for k in sorted({g: k for k, g in reversed(list(enumerate(group)))}.values())}
    seen, out = set(), {}
    for i, t in docs.items():
        words, gone = t.split(), set()
        for k in range(len(words) - 19):
            window = tuple(words[k:k + 20])
            gone |= set(range(k, k + 20)) if window in seen else set()
            seen.add(window)
        out[i] = " ".join(w for k, w in enumerate(words) if k not in gone) if gone else t
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return Counter({i: len(e.ids) + 1 for i, e in zip(out, tokenizer.encode_batch(list(out.values()), add_special_tokens=False))})


def test_pipeline(spark):
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    got: Counter = Counter()
    for p in pieces:
        got[p.doc_id] += p.length
    assert got == plain_run()
    assert all(p.offset + p.length <= 2048 for p in pieces)


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, "a " * 60, "en", "s", 5, "x"), (None, None, None, None, None, "y"), (1, "a " * 60, "en", "s", 5, "x")],
                                 "doc_id long, text string, lang string, source string, n_chars long, limits string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            done = stage(spark, table, FOLDER)
            assert done.columns == docs.columns, name
            assert done.count() <= table.count()
