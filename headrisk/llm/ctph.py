"""Context-triggered piecewise hashing.

A rolling hash of the last `ROLL` bytes ends a chunk wherever its low bits are all ones. The block size, a power of two, is the least
that gives at most `MOST_CHUNKS` boundaries, so a signature has about as many characters for a text of any length; the
boundaries at twice the block size are a part of them. Each chunk gives one of 64 characters, and the fingerprint is the block size
and the signatures at it, at twice and at four times the block, joined by colons, the chunk after the last boundary included. An edit changes the characters of the chunks it
touches, and no other.

Likeness compares signatures at the same block size: 1 minus the edit distance (insertions and deletions) over the two lengths, or 0
where the signatures share no run of `RUN` characters; of the sizes that both have, the best counts. Fingerprints without a common size have likeness 0.

Neighbours in descending order of id come from a range partitioning: each task holds a stretch of ids and goes through it with one document in hand.
The last document of a stretch, one for each task, is compared in a second, small job.

Nulls: a null text is empty, and an empty text has the fingerprint `1:::`; two of them have likeness 1. A null id comes last. Rows that share an id are
ordered by their text, so each has a next document; a single document is its own next one. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from headrisk.llm.common import MULTIPLIER, NULL_ID, bounded_batches, doc_key, from_key, mixed, saved

ROLL = 7
MOST_CHUNKS = 64
RUN = 4
#: Block sizes of a fingerprint, each twice the one before.
SIZES = 3
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_ROLL_FACTORS = [np.uint32(pow(0x01000193, j + 1, 2**32)) for j in range(ROLL)]
_INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 2**64))
#: Bytes for which powers are kept; longer texts get theirs for the one call.
_KEPT_POWERS = 1 << 20


@lru_cache(4)
def _kept_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return _kept_powers(int(base), _KEPT_POWERS)[:n] if n <= _KEPT_POWERS else _kept_powers.__wrapped__(int(base), n)


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, a mixed 32-bit hash of it and the ROLL - 1 before it."""
    wide = data.astype(np.uint32)
    out = wide * _ROLL_FACTORS[0]
    for j in range(1, min(ROLL, len(wide))):
        out[j:] += wide[:-j] * _ROLL_FACTORS[j]
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(13)
    return out


def fingerprint(text: bytes) -> str:
    """The fingerprint of a text's UTF-8 bytes."""
    if not text:
        return "1:::"
    data = np.frombuffer(text, np.uint8)
    roll = rolling(data)
    bits = max(0, (len(data) // (2 * MOST_CHUNKS)).bit_length() - 1)
    low = np.uint32((1 << bits) - 1)
    ends = np.flatnonzero((roll & low) == low)
    while len(ends) > MOST_CHUNKS:
        bits += 1
        low = np.uint32((1 << bits) - 1)
        ends = ends[(roll[ends] & low) == low]
    # a chunk's bytes as a polynomial, from sums that grow with the place and are scaled back to the chunk's start
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(MULTIPLIER, len(data)), dtype=np.uint64)
    scale = _powers(_INVERSE, len(data))

    def signature(at: np.ndarray) -> str:
        stops = at if len(at) and at[-1] == len(data) - 1 else np.r_[at, len(data) - 1]
        starts = np.r_[0, stops[:-1] + 1]
        totals = sums[stops] - np.where(starts > 0, sums[starts - 1], np.uint64(0))
        return _LETTERS[(mixed(totals * scale[starts]) >> np.uint64(58)).astype(np.int64)].tobytes().decode()

    found = []
    for k in range(SIZES):
        low = np.uint32((1 << (bits + k)) - 1)
        found.append(signature(ends[(roll[ends] & low) == low]))
    return ":".join([str(1 << bits), *found])


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each place of b."""
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    run = min(RUN, len(a), len(b))
    if not run or {a[i:i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i:i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """Likeness of two fingerprints, from 0 to 1; the same for either order."""
    if x == y:
        return 1.0
    (a, *own), (b, *other) = x.split(":"), y.split(":")
    if not own[0] or not other[0]:
        return 0.0
    return max((_alike(p, q) for i, p in enumerate(own) for j, q in enumerate(other) if int(a) << i == int(b) << j), default=0.0)


def edited(text: str, other: str) -> str:
    """The text with its last floor(n / 2) characters replaced by the first as many of another."""
    half = len(text) // 2
    return text[:len(text) - half] + other[:half]


_OUT = "doc long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FIELDS = [x.split()[0] for x in _OUT.split(", ")]


def _row(doc: int, text: str, own: str, next_text: str, next_own: str) -> tuple:
    new = edited(text, next_text).encode()
    mark = fingerprint(new)
    return doc, len(text), hashlib.sha256(new).hexdigest(), own, mark, likeness(own, mark), likeness(own, next_own)


def _batch(rows: list[tuple], part: int | None = None, place: int = 0) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    columns = dict(zip(_FIELDS, (pa.array(c, t) for c, t in zip(zip(*rows), types))))
    if part is not None:
        columns |= {"part": pa.array([part] * len(rows), pa.int64()), "place": pa.array(range(place, place + len(rows)), pa.int64())}
    return pa.RecordBatch.from_pydict(columns)


def _stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in order to their rows; the last of the task has nulls where the next document is needed. place counts from 0; the last has -1."""
    part, held, place = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            here = (doc, text, fingerprint(text.encode()))
            if held:
                rows.append(_row(*held, here[1], here[2]))
            held = here
        if rows:
            yield _batch(rows, part, place)
            place += len(rows)
    if held:
        yield _batch([(held[0], len(held[1]), None, held[2], None, None, None)], part, -1)


@F.arrow_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("edited_sha256", "edited_fingerprint")] + [T.StructField(n, T.DoubleType()) for n in ("near_edited", "near_next")]))
def _across(texts: pa.Array, others: pa.Array) -> pa.Array:
    rows = []
    for a, b in zip(texts, others):
        a, b = a.as_py() or "", b.as_py() or ""
        rows.append(_row(0, a, fingerprint(a.encode()), b, fingerprint(b.encode())))
    kinds = {"edited_sha256": (2, pa.string()), "edited_fingerprint": (4, pa.string()), "near_edited": (5, pa.float64()), "near_next": (6, pa.float64())}
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in kinds.values()], names=list(kinds))


def _mark() -> F.Column:
    """Orders rows that share an id; an empty text's is that of none."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """A row for each document: fingerprints of its text and of its edited text, and how alike they and the next document's are."""
    bounded_batches(docs.sparkSession)
    # ranges by a hash of the text: the sample that sets them goes to the driver
    order = [F.col("doc").desc(), F.col("mark").desc()]
    ranged = docs.select(doc_key().alias("doc"), "text", _mark()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = saved(ranged.drop("mark").mapInArrow(_stretch, f"{_OUT}, part long, place long"), "ctph")
    # borders of the tasks: two rows for each task that had documents
    ends = {r.part: r for r in rows.where("place = -1").select("part", "doc", "fingerprint", "n_chars").collect()}
    firsts = {r.part: r.doc for r in rows.where("place = 0").select("part", "doc").collect()}
    parts = sorted(ends)
    after = [(p, ends[p].doc, firsts.get(q, ends[q].doc), q) for p, q in zip(parts, parts[1:] + parts[:1])]
    if not after:
        return rows.select(from_key("doc").alias("doc_id"), *_FIELDS[1:])
    borders = docs.sparkSession.createDataFrame(after, "part long, last_doc long, first_doc long, next_part long")
    wanted = [x for _, a, b, _ in after for x in (a, b)]
    some = docs.where(doc_key().isin(wanted) if len(wanted) < 1000 else F.lit(True)).select(doc_key().alias("doc"), F.struct(_mark(), F.coalesce("text", F.lit("")).alias("text")).alias("x"))
    # of rows that share a border's id, the last of one task has the least mark there and the first of the next the greatest
    last = some.join(F.broadcast(borders), F.col("doc") == F.col("last_doc")).groupBy("part").agg(F.min("x").getField("text").alias("text"))
    first = some.join(F.broadcast(borders), F.col("doc") == F.col("first_doc")).groupBy("part").agg(F.max("x").getField("text").alias("next_text"))
    met = last.join(first, "part").select(F.col("part").alias("met_part"), _across("text", "next_text").alias("x"))
    ends_done = (rows.where("place = -1").join(F.broadcast(met), F.col("part") == F.col("met_part"))
                 .select("doc", "n_chars", F.col("x.edited_sha256").alias("edited_sha256"), "fingerprint", F.col("x.edited_fingerprint").alias("edited_fingerprint"),
                         F.col("x.near_edited").alias("near_edited"), F.col("x.near_next").alias("near_next")))
    return rows.where("place >= 0").select(*_FIELDS).union(ends_done).select(from_key("doc").alias("doc_id"), *_FIELDS[1:])
