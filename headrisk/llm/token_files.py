"""Token ids in files: shards of separately compressed documents, with a shared dictionary and an offset index.

A file set is two tables in a folder. `dictionary` has one row: the zstandard dictionary (trained on the serialized ids of a bounded
sample of documents: the `SAMPLE` ones with the smallest hash of their id, `SAMPLE_CHARS` characters of each in `SAMPLE_CUTS` cuts spread over its whole text) and its hash. `shards`
has a row for about `SHARD_BYTES` of compressed documents, in ascending order of their ids: the hash of the dictionary, the ids, token
counts and byte offsets of its documents, its tokens before it within its task's part, and the frames one after the other. A document is
read by its frame alone. The range partitioning gives every task a stretch of ids; the totals of the tasks are summed up on
reading, so `start` counts the ids of all documents before.

Nulls: a null text is empty and has the end id alone; a null id sorts first and comes back as null. Repeated ids are kept, each a
document, ordered by their text. An empty table gives files without shards. Other columns are not kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from headrisk.llm.common import bounded_batches, doc_key, from_key
from headrisk.llm.packing import TEXTS_AT_ONCE, part_starts
from headrisk.llm.tokens import encoder

SAMPLE = 2000
SAMPLE_CHARS = 4096
SAMPLE_CUTS = 8
DICTIONARY_BYTES = 64 << 10
SHARD_BYTES = 1 << 20
LEVEL = 3
_SHARD = ("part long, tokens_before long, n long, first_doc long, last_doc long, dictionary_hash string, width int, "
          "doc_ids array<long>, counts array<long>, ends array<long>, frames binary")


def _ids(texts: list[str | None], tokenizer: str, end_id: int, width: int) -> list[np.ndarray]:
    end = np.array([end_id], "<u4").tobytes()
    return [np.frombuffer(x + end, "<u4").astype(f"<u{width}", copy=False) for x in encoder(tokenizer).ids(texts)]


@lru_cache(2)
def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    if not data:
        return None
    found = zstandard.ZstdCompressionDict(data)
    found.precompute_compress(level=LEVEL)  # else every document's compression starts by reading the dictionary
    return found


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> bytes:
    """A zstandard dictionary, or nothing if there are too few documents for one."""
    mark = F.xxhash64(doc_key())
    bound = docs.select(mark.alias("h")).orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    if bound is None:
        return b""

    def serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"ids": [x.tobytes() for x in _ids(batch.column(0).to_pylist(), tokenizer, end_id, width)]})

    cut, length = SAMPLE_CHARS // SAMPLE_CUTS, F.greatest(F.length("text"), F.lit(SAMPLE_CHARS))
    cuts = F.concat(*[F.substring("text", F.floor(length * k / SAMPLE_CUTS).cast("int") + 1, F.lit(cut)) for k in range(SAMPLE_CUTS)])
    some = docs.where(mark <= bound).select(cuts.alias("text")).limit(SAMPLE).mapInArrow(serialized, "ids binary")
    samples = sorted(bytes(r.ids) for r in some.collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def _write(tokenizer: str, end_id: int, width: int, data: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(data))
        part, before, mark = TaskContext.get().partitionId(), 0, hashlib.sha256(data).hexdigest()
        docs, counts, frames, size = [], [], [], 0

        def shard() -> pa.RecordBatch:
            row = {"part": part, "tokens_before": before, "n": sum(counts), "first_doc": docs[0], "last_doc": docs[-1], "dictionary_hash": mark, "width": width,
                   "doc_ids": docs, "counts": counts, "ends": np.cumsum([len(x) for x in frames]).tolist(), "frames": b"".join(frames)}
            return pa.RecordBatch.from_pydict({k: pa.array([v], pa.int32()) if k == "width" else [v] for k, v in row.items()})

        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(i, TEXTS_AT_ONCE)
                for doc, ids in zip(some.column(0).to_pylist(), _ids(some.column(1).to_pylist(), tokenizer, end_id, width)):
                    docs.append(doc)
                    counts.append(len(ids))
                    frames.append(press.compress(ids.tobytes()))
                    size += len(frames[-1])
                    if size >= SHARD_BYTES:
                        yield shard()
                        before += sum(counts)
                        docs, counts, frames, size = [], [], [], 0
        if docs:
            yield shard()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Writes the file set of all documents into the folder."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    width = 2 if max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id) < 65536 else 4
    data = train_dictionary(docs, tokenizer, end_id, width)
    spark.createDataFrame([(hashlib.sha256(data).hexdigest(), data)], "dictionary_hash string, data binary").write.parquet(f"{path}/dictionary")
    ranged = docs.select(doc_key().alias("doc"), "text").repartitionByRange("doc").sortWithinPartitions("doc", "text")
    ranged.mapInArrow(_write(tokenizer, end_id, width, data), _SHARD).write.option("compression", "uncompressed").parquet(f"{path}/shards")


def _read(wanted: int | None, data: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress, mark = zstandard.ZstdDecompressor(dict_data=_dictionary(data)), hashlib.sha256(data).hexdigest()
        for batch in batches:
            for row in range(batch.num_rows):
                shard = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                if shard["dictionary_hash"] != mark:
                    raise ValueError("the shard was written with another dictionary")
                counts, ends = np.array(shard["counts"], np.int64), [0, *shard["ends"]]
                starts = shard["begin"] + np.cumsum(counts) - counts
                some = [i for i, d in enumerate(shard["doc_ids"]) if wanted is None or d == wanted]
                ids = [np.frombuffer(unpress.decompress(shard["frames"][ends[i]:ends[i + 1]]), f"<u{shard['width']}").astype("<u4").tobytes() for i in some]
                yield pa.RecordBatch.from_arrays([pa.array([shard["doc_ids"][i] for i in some], pa.int64()), pa.array(starts[some]), pa.array(counts[some]), pa.array(ids, pa.binary())],
                                                 names=["doc", "start", "n_tokens", "ids"])

    return run


def read_tokens(spark: SparkSession, path: str, doc_id: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of all documents, or of one: then only shards that can hold it are read."""
    shards = spark.read.schema(_SHARD).parquet(f"{path}/shards")
    data = bytes(spark.read.parquet(f"{path}/dictionary").first().data)
    starts = part_starts(shards.groupBy("part").agg(F.sum("n").alias("n")))
    if doc_id is not None:
        shards = shards.where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    # one row for each task that wrote: bounded by the number of tasks
    placed = shards.join(F.broadcast(starts), "part").select("dictionary_hash", "width", "doc_ids", "counts", "ends", "frames", (F.col("base") + F.col("tokens_before")).alias("begin"))
    return placed.mapInArrow(_read(doc_id, data), "doc long, start long, n_tokens long, ids binary").select(from_key("doc").alias("doc_id"), "start", "n_tokens", "ids")
