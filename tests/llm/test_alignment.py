"""Alignment against a plain loop over all pairs of tokens."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from headrisk.llm import alignment, op11

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, block string, kind int, code long, n_a string"


def texts() -> list[str | None]:
    pick = random.Random(3)
    some = ["".join(pick.choice(["the", "ing", " ", " ", "\n", "straße", "中", ".", "<s>", "a"]) for _ in range(pick.randint(1, 60))) for _ in range(60)]
    return [*some, some[3], some[3], None, "", " ", "\n", " lead", "trail  ", "a  b\n\n c", "a\n  b", "<|endoftext|> <0x41> </s>", "a▁b", "tab\tx\r\ny", "🜲 ﬁ　é", "a\x00b", "word " * 9000]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("aligned"))
    rows = [(None if i == 5 else i // 2 * 2, t, "x", 1, 2, "y") for i, t in enumerate(texts())]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    return path


class Plain:
    def __init__(self) -> None:
        import sentencepiece
        from tokenizers import Tokenizer, decoders

        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        alphabet = alignment.byte_alphabet()
        assert len(alphabet) == 256 and decoders.ByteLevel().decode([c for c, b in alphabet.items() if 32 < b < 127]) == "".join(map(chr, range(33, 127)))
        self.a_bytes = lambda i: bytes(alphabet[c] for c in self.a.id_to_token(i))
        self.b_bytes = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    def spans(self, ids, as_bytes):
        found, at = [], 0
        for i in ids:
            found.append((at, at + len(as_bytes(i)), i))
            at = found[-1][1]
        return found

    def __call__(self, text):
        """(A spans, B spans, groups, links)"""
        if not text:
            return [], [], "", []
        a, b = self.spans(self.a.encode(" " + text, add_special_tokens=False).ids, self.a_bytes), self.spans(self.b.encode(text), self.b_bytes)
        whole = (" " + text).encode()
        if b"".join(self.a_bytes(i) for *_, i in a) != whole or b"".join(self.b_bytes(i) for *_, i in b) != whole:
            return [], [], "", []
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups = ["|".join(",".join(str(i) for s, e, i in side if low <= s and e <= high) for side in (a, b)) for low, high in zip([0, *ends], ends)]
        if len(a) > 5000:  # the long text: its links by the tokens' own bounds
            cuts = sorted({s for s, _, _ in a} | {s for s, _, _ in b})
            ia = ib = 0
            links = []
            for c in cuts:
                while a[ia][1] <= c:
                    ia += 1
                while b[ib][1] <= c:
                    ib += 1
                links.append((a[ia][2], b[ib][2]))
            return a, b, ";".join(groups), links
        return a, b, ";".join(groups), [(i, j) for s, e, i in a for u, v, j in b if max(s, u) < min(e, v)]


def expected(rows) -> Counter:
    plain, seen = Plain(), {}
    found = [(i, seen.setdefault(t, plain(t) if t not in seen else seen[t])) for i, t in rows]
    count = Counter(link for _, (*_, links) in found for link in links)
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return Counter((i, len(a), len(b), g.count(";") + 1 if g else 0, len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), g)
                   for i, (a, b, g, links) in found)


@pytest.mark.parametrize("block", [alignment.BLOCK_LINKS, 200])
def test_alignment(spark, folder, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_LINKS", block)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    if block == 200:  # small blocks: the closure has to carry the setting
        first = spark.createDataFrame([], alignment._FIRST)
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        import pyarrow as pa
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})
        monkeypatch.setattr(alignment, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))}))
        parts = [r for b in alignment._first_pass(A, B, False, 100)(iter([batch])) for r in b.to_pylist()]
        first = spark.createDataFrame([tuple(r[c] for c in first.columns) for r in parts], first.schema)
        assert first.where("codes IS NOT NULL").count() > 1
        got = alignment.with_counts(first, alignment.pair_counts(first, B))
    else:
        got = alignment.align(docs, A, B)
    want = expected([(r.doc_id, r.text) for r in docs.collect()])
    assert Counter(map(tuple, got.collect())) == want


def test_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = Counter((*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in expected([(r.doc_id, r.text) for r in docs.collect()]).elements())
    got = op11.query(spark, folder)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert op11.query(spark, str(tmp_path)).collect() == []
