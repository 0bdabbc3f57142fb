"""Alignment of the tokens that two tokenizers give the same texts.

Tokenizer A encodes a space and the text, tokenizer B the text, to which it adds the space itself, so the tokens of both tile the same bytes. All
tokens of both are sorted by start (lexsort); the running maximum of their ends breaks them into groups wherever a start reaches it; within a group
each distinct start gives one link, that of the A token and the B token that cover it, which are all pairs whose byte ranges overlap.

A text is a chain of pieces (spaces and newlines with what follows them) across which neither tokenizer joins anything, so ends meet at their
borders and a worker remembers the aligned pieces it met. Documents come in blocks of about BLOCK_LINKS links. A block hands on its distinct id pairs with
counts; these are summed up over the corpus, compared with the highest count of their B id, and go back to the blocks that asked, in
sorted partitions. A pair is asked for once a block, however often it occurs, and the only table that is broadcast has a row for each B id at most.

Nulls: a null text, an empty one, and one whose tokens' bytes are not the space and the text (as where B takes U+2581 for a space) has no tokens: zeros and
an empty text of groups. A null id stays null. Repeated rows are aligned, and counted, each on its own. Texts of any length are aligned whole. An empty
table gives an empty result. Columns other than doc_id and text are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from headrisk.llm.common import Memory, bounded_batches, saved

#: Links of a block, or one document more.
BLOCK_LINKS = 4_000_000
#: Pieces that a worker remembers for certain; at most twice as many.
REMEMBERED = 250_000
TEXTS_AT_ONCE = 64

_PIECE = re.compile(r"[ \n]+[^ \n]*")
#: Texts with white space or format characters besides space and newline are aligned as one piece.
_OTHER_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85᠎​⁠▁﻿]")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")

_FIRST = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links binary, codes binary, counts binary"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
_NO_TOKENS = (0, 0, 0, b"", b"")


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for the bytes: visible Latin-1 as itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Aligns texts by a byte-level `tokenizers` file and a `sentencepiece` model."""

    def __init__(self, a_path: str, b_path: str, remember: int = REMEMBERED) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        entries = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(map(alphabet.__getitem__, t)) if alphabet.keys() >= set(t) else t.encode() for t in (entries.get(i, "") for i in range(max(entries) + 1))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(_BYTE_PIECE.fullmatch(p)[1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if len(self.a_bytes) * len(self.b_bytes) > 2**32:
            raise ValueError("pairs of ids do not fit 32 bits")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        ids = [str(i).encode() for n in (len(self.a_bytes), len(self.b_bytes)) for i in range(n)]
        #: An id of A, or of B after those of A, as it is written before a comma, a bar and a semicolon.
        self.shown = [i + mark for i in ids for mark in (b",", b"|", b";")]
        self.shown_sizes = np.array([len(i) + 1 for i in ids], np.int64)
        #: No piece joins a newline, or a space after something else, so texts can be cut there.
        self.cuts = not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)
        self.space = self.b.piece_to_id("▁")
        self.known = Memory(remember)

    def _b_ids(self, pieces: list[str]) -> list[list[int]]:
        """B's ids of texts that begin with a space, which B adds, or with a newline, where its space is taken off again."""
        found = self.b.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1)
        return [ids if p[0] == " " else ids[1:] if ids[:1] == [self.space] else [] for p, ids in zip(pieces, found)]

    def aligned(self, pieces: list[str]) -> list[tuple | None]:
        """(A tokens, B tokens, groups, their text, links' codes) of each text, which begins with a space or newline; None where bytes differ."""
        a_ids = [x.ids for x in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        b_ids = self._b_ids(pieces)
        good = self._tiled(pieces, a_ids, b_ids)
        result: list[tuple | None] = [None] * len(pieces)
        if not all(good):
            a_ids, b_ids = ([x for x, ok in zip(ids, good) if ok] for ids in (a_ids, b_ids))
            if not a_ids:
                return result
        counts_a, counts_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (a_ids, b_ids))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, n.sum()) for ids, n in ((a_ids, counts_a), (b_ids, counts_b)))
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        start = np.concatenate([ends_a - self.a_sizes[a], ends_b - self.b_sizes[b]])
        end = np.concatenate([ends_a, ends_b])
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((side, start))
        start, end, side = start[order], end[order], side[order]
        reach = np.maximum.accumulate(end)
        group = np.cumsum(np.concatenate([[True], start[1:] >= reach[:-1]])) - 1
        # each distinct start: the last A and the last B token that began cover it
        last = np.concatenate([start[1:] != start[:-1], [True]])
        current_a, current_b = np.cumsum(side == 0)[last] - 1, np.cumsum(side == 1)[last] - 1
        codes = (a[current_a] * len(self.b_bytes) + b[current_b]).astype("<u4").tobytes()
        # tokens by group, A before B, each written with the mark that follows it
        token = np.concatenate([a, b + len(self.a_bytes)])[order]
        written = np.lexsort((side, group))
        token, side, group_of = token[written], side[written], group[written]
        more = np.concatenate([group_of[1:] == group_of[:-1], [False]])
        mark = np.where(more, np.where(np.concatenate([side[1:] != side[:-1], [False]]), 1, 0), 2)
        shown = b"".join(map(self.shown.__getitem__, (3 * token + mark).tolist()))
        until = np.concatenate([[0], np.cumsum(self.shown_sizes[token])])
        # ends meet where texts meet, so each text has whole groups and links, and its tokens are written together
        tokens = np.concatenate([[0], np.cumsum(counts_a + counts_b)])
        shown_at = until[tokens].tolist()
        groups_at = np.concatenate([group_of, [group_of[-1] + 1]])[tokens].tolist()
        text_ends = ends_a[np.cumsum(counts_a) - 1]
        links_at = (4 * np.searchsorted(start[last], np.concatenate([[0], text_ends]))).tolist()
        found = zip(counts_a.tolist(), counts_b.tolist(), groups_at, groups_at[1:], shown_at, shown_at[1:], links_at, links_at[1:])
        rows = iter([(n, m, h - g, shown[i: j - 1], codes[k:x]) for n, m, g, h, i, j, k, x in found])
        return [next(rows) if ok else None for ok in good]

    def _tiled(self, pieces: list[str], a_ids: list[list[int]], b_ids: list[list[int]]) -> list[bool]:
        """Whether the tokens' bytes, joined, are the text, for both."""
        a, b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        return [b"".join(map(a, x)) == p.encode() == b"".join(map(b, y)) for p, x, y in zip(pieces, a_ids, b_ids)]

    def texts(self, texts: list[str | None]) -> list[tuple]:
        """The same for texts, meant for some dozens at a time, whose new pieces are aligned together."""
        split = [_PIECE.findall(" " + t) if self.cuts and t and not _OTHER_SPACE.search(t) else None for t in texts]
        new = list(self.known.missing(set().union(*filter(None, split))))
        known = self.known.now
        if new:
            known.update(zip(new, self.aligned(new)))
        result = []
        for text, pieces in zip(texts, split):
            parts = list(map(known.__getitem__, pieces)) if pieces else [None]
            if not text:
                result.append(_NO_TOKENS)
            elif None in parts:
                result.append(self.aligned([" " + text])[0] or _NO_TOKENS)
            else:
                a, b, n, shown, links = zip(*parts)
                result.append((sum(a), sum(b), sum(n), b";".join(shown), b"".join(links)))
        return result


@lru_cache(1)
def aligner(a_path: str, b_path: str, remember: int) -> Aligner:
    """The aligner of a worker, kept between its tasks."""
    return Aligner(a_path, b_path, remember)


def _first_pass(a_path: str, b_path: str, hashed: bool, remember: int):
    """(doc_id, text) to rows of documents, and a row with the distinct pairs of each block after its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, block = aligner(a_path, b_path, remember), TaskContext.get().partitionId() << 32
        held: list[bytes] = []
        size = 0

        def pairs() -> pa.RecordBatch:
            codes, counts = np.unique(np.frombuffer(b"".join(held), "<u4"), return_counts=True)
            return _rows(block=[block], codes=[codes.tobytes()], counts=[counts.astype("<u4").tobytes()])

        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(i, TEXTS_AT_ONCE)
                found = align.texts(some.column(1).to_pylist())
                a, b, n, shown, links = map(list, zip(*found))
                groups = [hashlib.sha256(s).hexdigest() if s else "" for s in shown] if hashed else [s.decode() for s in shown]
                yield _rows(block=[block] * len(found), doc_id=some.column(0), n_a=a, n_b=b, n_groups=n, n_links=[len(x) // 4 for x in links], groups=groups, links=links)
                held += links
                size += sum(map(len, links)) // 4
                if size >= BLOCK_LINKS:
                    yield pairs()
                    held, size, block = [], 0, block + 1
        if size:
            yield pairs()

    return run


_FIRST_ARROW = pa.schema([(c, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for c, t in (x.split() for x in _FIRST.split(", "))])


def _rows(**columns) -> pa.RecordBatch:
    n = len(columns["block"])
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if isinstance(columns.get(f.name), list) else columns.get(f.name, pa.nulls(n, f.type))
                                       for f in _FIRST_ARROW], schema=_FIRST_ARROW)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, codes, counts in zip(*(c.to_pylist() for c in batch.columns)):
            codes, counts = np.frombuffer(codes, "<u4").astype(np.int64), np.frombuffer(counts, "<u4").astype(np.int64)
            for i in range(0, len(codes), 100_000):
                some = codes[i: i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), pa.array(some), pa.array(counts[i: i + 100_000])], names=["block", "code", "n"])


def _second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, answers (kind 0, by code) before documents (kind 1)."""
    block, parts, codes, counts, best = None, [], None, None, None
    for batch in batches:
        blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
        cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            some = batch.slice(i, j - i)
            if blocks[i] != block:
                block, parts, codes = blocks[i], [], np.array([], np.int64)
            if kinds[i] == 0:
                parts.append([some.column(c).to_numpy(zero_copy_only=False) for c in ("code", "n", "best")])
                continue
            if parts:
                codes, counts, best = (np.concatenate(x) for x in zip(*parts))
                parts = []
            links = some.column("links").to_pylist()
            at = np.searchsorted(codes, np.frombuffer(b"".join(links), "<u4"))
            ends = np.cumsum([len(x) // 4 for x in links])
            sums = [np.concatenate([[0], np.cumsum(x[at])])[[*(ends - [len(x) // 4 for x in links]), *ends]].reshape(2, -1) for x in (best, counts)] if len(at) else [np.zeros((2, len(links)), np.int64)] * 2
            n_best, count_sum = (pa.array((x[1] - x[0]).astype(np.int64)) for x in sums)
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
            yield pa.RecordBatch.from_arrays([n_best if c == "n_best" else count_sum if c == "count_sum" else some.column(c) for c in names], names=names)


def first_pass(docs: DataFrame, a_path: str, b_path: str, hashed: bool = False, remember: int = REMEMBERED) -> DataFrame:
    """Documents with their groups and links, and the distinct pairs of each block, written to the shared folder."""
    bounded_batches(docs.sparkSession)
    return saved(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_first_pass(a_path, b_path, hashed, remember), _FIRST), "alignment")


def _asked(first: DataFrame) -> DataFrame:
    return first.where("codes IS NOT NULL").select("block", "codes", "counts").mapInArrow(_unpacked, "block long, code long, n long")


def pair_counts(first: DataFrame, b_path: str) -> DataFrame:
    """code, a, b, n and best for each pair of ids linked anywhere: whether no other A id is linked with the B id more often."""
    import sentencepiece

    size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    counts = saved(_asked(first).groupBy("code").agg(F.sum("n").alias("n")), "pair-counts").withColumn("b", F.col("code") % size)
    top = counts.groupBy("b").agg(F.max("n").alias("top"))  # a row for each id of B's vocabulary at most
    return counts.join(F.broadcast(top), "b").select("code", F.expr(f"code div {size}").alias("a"), "b", "n", (F.col("n") == F.col("top")).alias("best"))


def with_counts(first: DataFrame, pairs: DataFrame) -> DataFrame:
    """The documents of a first pass with n_best and count_sum."""
    answers = _asked(first).select("block", "code").join(pairs.select("code", "n", "best"), "code").withColumn("kind", F.lit(0))
    documents = first.where("codes IS NULL").drop("codes", "counts").withColumn("kind", F.lit(1))
    both = answers.unionByName(documents, allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", "kind", "code").mapInArrow(_second_pass, _RESULT)


def align(docs: DataFrame, a_path: str, b_path: str, hashed: bool = False, remember: int = REMEMBERED) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, and groups as `a1,a2|b1;a3|b2,b3`, or its SHA-256 where hashed."""
    first = first_pass(docs, a_path, b_path, hashed, remember)
    return with_counts(first, pair_counts(first, b_path))
