"""Packing by concatenating and cutting.

All documents' ids, each document closed by an end id, form one long stream, in the order in which their tasks read them. Pass one writes
each document's ids with its task and its place in the task's part of the stream. The totals of the tasks, one number each,
are summed up in order, which gives every part its place in the whole. Pass two cuts the stream into windows of a fixed size: a row for
each piece of a document, a boundary record, tells where it starts in its document and in its window. Only the last
window can be short, so a window is a sequence without padding but for that one.

Nulls: a null text has the end id alone; a null id stays null. Repeated rows are packed each on its own; texts of
any length are cut as often as needed. An empty table gives no piece. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from headrisk.llm.common import bounded_batches, saved
from headrisk.llm.tokens import REMEMBERED, encoder

SIZE = 2048
TEXTS_AT_ONCE = 4096
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def tokenize(tokenizer: str, end_id: int, remember: int = REMEMBERED):
    """(doc_id, text) to part, doc_id, place in the part, number of ids, ids."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, place = encoder(tokenizer, remember), TaskContext.get().partitionId(), 0
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(i, TEXTS_AT_ONCE)
                ids = [x + end for x in encode.ids(some.column(1).to_pylist())]
                counts = np.array([len(x) // 4 for x in ids], np.int64)
                ends = place + np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int64)), some.column(0), pa.array(ends - counts), pa.array(counts),
                                                  pa.array([_narrow(x) for x in ids], pa.binary())], names=["part", "doc_id", "place", "n", "ids"])
                place = int(ends[-1])
        encode.known.before = {}  # what rests in an idle worker is half as much

    return run


def _narrow(ids: bytes) -> bytes:
    """Ids in two bytes each where all fit, with the width in front."""
    wide = np.frombuffer(ids, "<u4")
    return b"\2" + wide.astype("<u2").tobytes() if wide.max(initial=0) < 65536 else b"\4" + ids


def _wide(ids: bytes) -> bytes:
    return np.frombuffer(ids, "<u2", offset=1).astype("<u4").tobytes() if ids[0] == 2 else ids[1:]


def part_starts(totals: DataFrame) -> DataFrame:
    """part and n, a row for each task of an earlier job, to part and base: the sum of n over the parts before it."""
    rows = sorted((r.part, r.n) for r in totals.select("part", "n").collect())
    bases = accumulate((n for _, n in rows), initial=0)
    return totals.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(rows, bases)], "part long, base long")


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {k: [] for k in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")}
            for doc_id, begin, n, ids in zip(batch.column("doc_id").to_pylist(), batch.column("begin").to_pylist(), batch.column("n").to_pylist(), batch.column("ids")):
                wide, start = _wide(ids.as_py()), 0
                while start < n:
                    sequence, offset = divmod(begin + start, size)
                    length = min(size - offset, n - start)
                    for k, v in zip(at, (doc_id, start, length, n, sequence, offset, wide[4 * start: 4 * (start + length)])):
                        at[k].append(v)
                    start += length
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in at.items()})

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SIZE, remember: int = REMEMBERED) -> DataFrame:
    """The pieces of all documents, with their ids as little-endian unsigned 32-bit integers."""
    bounded_batches(docs.sparkSession)
    ids = saved(docs.select("doc_id", "text").mapInArrow(tokenize(tokenizer, end_id, remember), "part long, doc_id long, place long, n long, ids binary"), "packed-ids")
    starts = part_starts(ids.groupBy("part").agg(F.sum("n").alias("n")))
    # one row for each task of pass one: its bound is the number of tasks, not of documents
    placed = ids.join(F.broadcast(starts), "part").select("doc_id", (F.col("base") + F.col("place")).alias("begin"), "n", "ids")
    return placed.mapInArrow(_cut(size), PIECES)
