"""Line dedup: lines whose key occurs in many documents are dropped from all of them.

A key is the line stripped of \\x20 and \\x09-\\x0D at both ends, with A-Z in lower case; it is handled as a 128-bit hash. The
distinct hashes are dealt to shards of about `KEYS_IN_SHARD`. Each shard gets a minimal perfect hash (levels of bit arrays; a key
takes the first level where no other key of the rest has its bit, its rank among the set bits is its index) that
indexes an array of 32-bit fingerprints and one of document counts, cut off at the limit. Documents are grouped in blocks by a hash
of their id. A block asks for each of its keys once, so a line that every document holds costs a row for each block and not
for each document; shards and questions meet in sorted partitions, which are read as a stream, and so do the answers and the
documents of a block. No line is joined, and nothing has to fit one task but a shard and the distinct frequent keys of one block.

Nulls: a null text is one empty line, whose key is empty and never dropped; a null id is an id like any other. Repeated
rows count as documents of their own. An empty table gives an empty result. Extra columns pass through `drop_common_lines`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from headrisk.llm.common import as_came, as_long, as_unsigned, bounded_batches, carried, doc_key, mixed, saved, whole_groups

MIN_DOCS = 10
DOCS_IN_BLOCK = 1000
KEYS_IN_SHARD = 20_000
_SPACES = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and their keys' hashes; an empty key has an empty hash."""
    lines = (text or "").encode().split(b"\n")
    keys = [x.strip(_SPACES).lower() for x in lines]
    return lines, [xxhash.xxh3_128_digest(k) if k else b"" for k in keys]


# -- minimal perfect hash ------------------------------------------------------------------------------------------------

def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(h1 + mixed(h2 + np.uint64(level * 2 + 1))) % np.uint64(size)).astype(np.int64)


def build_mph(h1: np.ndarray, h2: np.ndarray) -> bytes:
    """A function for distinct pairs of 64-bit values: sizes of the levels, then their bits."""
    rest, sizes, levels = np.arange(len(h1)), [], []
    while len(rest):
        size = max(64, -(-2 * len(rest) // 64) * 64)
        at = _place(h1[rest], h2[rest], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        levels.append(np.packbits(alone))
        rest = rest[~alone[at]]
    return np.array([len(sizes), *sizes], "<i8").tobytes() + b"".join(x.tobytes() for x in levels)


class PerfectHash:
    """Reads what `build_mph` made; gives a key its index, and a stranger any index or -1."""

    def __init__(self, data: bytes) -> None:
        count = int(np.frombuffer(data, "<i8", 1)[0])
        self.sizes = np.frombuffer(data, "<i8", count, 8).tolist()
        self.bits, self.ranks, start, base = [], [], 8 + 8 * count, 0
        for size in self.sizes:
            bits = np.unpackbits(np.frombuffer(data, np.uint8, size // 8, start))
            self.bits.append(bits)
            self.ranks.append(np.cumsum(bits, dtype=np.int64) + (base - 1))
            start, base = start + size // 8, base + int(bits.sum())

    def index(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out, rest = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, size in enumerate(self.sizes):
            if not len(rest):
                break
            at = _place(h1[rest], h2[rest], level, size)
            hit = self.bits[level][at] == 1
            out[rest[hit]] = self.ranks[level][at[hit]]
            rest = rest[~hit]
        return out


def fingerprints(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (mixed(h2 ^ (h1 >> np.uint64(7))) >> np.uint64(32)).astype("<u4")


# -- the jobs ------------------------------------------------------------------------------------------------------------

def _keys_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, text) to the distinct keys of each block, with the number of documents that have them."""
    for batch in batches:
        found: Counter = Counter()
        for block, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found.update((block, k) for k in set(line_keys(text.as_py())[1]) if k)
        if found:
            halves = np.frombuffer(b"".join(k for _, k in found), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                                              pa.array(list(found.values()), pa.int64())], names=["block", "h1", "h2", "n"])


def _build_shards(min_docs: int):
    kind = "<u1" if min_docs < 256 else "<u4"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, lambda t: t.column("shard").to_numpy(), KEYS_IN_SHARD):
            shard = table.column("shard").to_numpy()
            h1, h2, n = (table.column(c).to_numpy() for c in ("h1", "h2", "n"))
            borders = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            for a, b in zip(borders, borders[1:]):
                x, y = as_unsigned(h1[a:b]), as_unsigned(h2[a:b])
                mph = build_mph(x, y)
                at = PerfectHash(mph).index(x, y)
                marks, counts = np.zeros(b - a, "<u4"), np.zeros(b - a, kind)
                marks[at], counts[at] = fingerprints(x, y), np.minimum(n[a:b], min_docs)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard[a]], pa.int64()), "mph": [mph], "marks": [marks.tobytes()], "counts": [counts.tobytes()]})

    return build


def _probe(min_docs: int):
    kind = "<u1" if min_docs < 256 else "<u4"

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mph, marks, counts = None, None, None, None
        for batch in batches:
            shard, arrays = batch.column("shard").to_numpy(), batch.column("mph")
            h1, h2, block = (pc.fill_null(batch.column(c), 0).to_numpy() for c in ("h1", "h2", "block"))
            borders = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else np.zeros(0, int)
            for a, b in zip(borders, borders[1:]):
                if arrays[a].is_valid:
                    now, mph = shard[a], PerfectHash(arrays[a].as_py())
                    marks = np.frombuffer(batch.column("marks")[a].as_py(), "<u4")
                    counts = np.frombuffer(batch.column("counts")[a].as_py(), kind)
                    a += 1
                if a == b:
                    continue
                if shard[a] != now:
                    raise ValueError(f"shard {shard[a]} has questions and no arrays")
                x, y = as_unsigned(h1[a:b]), as_unsigned(h2[a:b])
                at = mph.index(x, y)
                often = (at >= 0) & (marks[at] == fingerprints(x, y)) & (counts[at] >= min_docs)
                if often.any():
                    yield pa.RecordBatch.from_arrays([pa.array(block[a:b][often]), pa.array(as_long(x[often])), pa.array(as_long(y[often]))],
                                                     names=["block", "h1", "h2"])

    return probe


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of a block, then its documents, whose other columns pass through."""
    now, dropped = None, set()
    for batch in batches:
        if not batch.num_rows:
            continue
        texts, n_lines, n_dropped, rows = [], [], [], []
        blocks, asked = batch.column("_block").to_pylist(), batch.column("_kind").to_pylist()
        h1, h2 = batch.column("_h1").to_pylist(), batch.column("_h2").to_pylist()
        for i, (block, kind, text) in enumerate(zip(blocks, asked, batch.column("text"))):
            if block != now:
                now, dropped = block, set()
            if kind == 0:
                dropped.add(np.array([h1[i], h2[i]], "<i8").tobytes())
                continue
            lines, keys = line_keys(text.as_py())
            kept = [x for x, k in zip(lines, keys) if k not in dropped] if dropped else lines
            rows.append(i)
            texts.append(b"\n".join(kept).decode() if text.is_valid or len(kept) < len(lines) else None)
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        if rows:
            out = batch.take(pa.array(rows)).drop_columns(["_block", "_kind", "_h1", "_h2"])
            out = out.set_column(out.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
            yield out.append_column("_n_lines", pa.array(n_lines, pa.int64())).append_column("_n_dropped", pa.array(n_dropped, pa.int64()))


def common_keys(docs: DataFrame, n_blocks: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """block, h1, h2: the keys of each block's documents that at least min_docs documents have."""
    blocks = docs.select(_block(n_blocks).alias("block"), "text")
    asked = saved(blocks.mapInArrow(_keys_of_blocks, "block long, h1 long, h2 long, n long").groupBy("block", "h1", "h2").agg(F.sum("n").alias("n")), "line-keys")
    shards = max(1, -(-asked.count() // KEYS_IN_SHARD))
    shard = F.pmod(F.shiftright("h1", 20), F.lit(shards)).alias("shard")
    counts = asked.groupBy("h1", "h2").agg(F.sum("n").alias("n")).select(shard, "h1", "h2", "n")
    arrays = counts.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        _build_shards(min_docs), "shard long, mph binary, marks binary, counts binary")
    questions = asked.select(shard, F.lit(None).cast("binary").alias("mph"), F.lit(None).cast("binary").alias("marks"),
                             F.lit(None).cast("binary").alias("counts"), "block", "h1", "h2")
    none = F.lit(None).cast("long")
    both = questions.unionByName(arrays.select("*", none.alias("block"), none.alias("h1"), none.alias("h2")))
    return (both.repartition("shard").sortWithinPartitions("shard", F.col("mph").isNull())
            .mapInArrow(_probe(min_docs), "block long, h1 long, h2 long"))


def _block(n_blocks: int) -> F.Column:
    return F.pmod(F.xxhash64(doc_key()), F.lit(n_blocks))


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with the lines left in `text`, and _n_lines (before) and _n_dropped, unless docs has columns of these names, which stay."""
    bounded_batches(docs.sparkSession)
    came, used = docs, ["doc_id", "text"]
    docs = carried(came, used)
    n_blocks = max(1, -(-docs.count() // DOCS_IN_BLOCK))
    keys = common_keys(docs, n_blocks, min_docs)
    none = F.lit(None).cast("long")
    own = docs.select("*", _block(n_blocks).alias("_block"), F.lit(1).alias("_kind"), none.alias("_h1"), none.alias("_h2"))
    answers = keys.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema], F.col("block").alias("_block"),
                          F.lit(0).alias("_kind"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
    counts = ("_n_lines", "_n_dropped")
    schema = T.StructType([*docs.schema, *[T.StructField(c, T.LongType()) for c in counts]])
    done = own.union(answers).repartition("_block").sortWithinPartitions("_block", "_kind").mapInArrow(_rewrite, schema)
    return as_came(done, came, used, counts)
