"""Helpers shared by the operators: tables kept in the shared folder, words, and null ids."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Stands for a null id inside a job, so that ids can be compared and sorted; it leaves as null again.
NULL_ID = -(2**63)
#: An odd multiplier for polynomial hashes modulo 2^64.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

#: Bytes of a batch between Spark and Python.
BATCH_BYTES = 8 << 20

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    return _own_folder.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="headrisk-"))


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session hands Python at most BATCH_BYTES at once, or one row: texts can be long, and by default only rows are counted."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The frame written as a table in the shared folder and read again: later jobs depend on the files only."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def carried(docs: DataFrame, used: list[str]) -> DataFrame:
    """The columns that an operator reads, and all others in one struct, so that their names meet none of the operator's."""
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in used]
    return docs.select(*used, F.struct(F.lit(0).alias("none"), *rest).alias("_rest"))


def as_came(done: DataFrame, docs: DataFrame, used: list[str], counts: tuple[str, ...] = ()) -> DataFrame:
    """The columns of docs again, then those of `counts` whose names docs does not have."""
    own = [F.col(f"`{c}`") if c in used else F.col(f"_rest.c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return done.select(*own, *[c for c in counts if c not in docs.columns])


def doc_key(column: str = "doc_id") -> F.Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def from_key(column: str) -> F.Column:
    return F.when(F.col(column) != NULL_ID, F.col(column))


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than \\x20 and \\x09-\\x0D, which is how bytes split by default; null has none."""
    return text.encode().split() if text else []


def parts_of(texts: list[str], chars: int) -> Iterator[list[str]]:
    """Consecutive texts of at most so many characters together, or one longer text."""
    some: list[str] = []
    size = 0
    for t in texts:
        if some and size + len(t) > chars:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def batches_of(rows: Iterator[dict], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    """Rows gathered into batches."""
    some: list[dict] = []
    for row in rows:
        some.append(row)
        if len(some) >= size:
            yield pa.RecordBatch.from_pylist(some, schema)
            some = []
    if some:
        yield pa.RecordBatch.from_pylist(some, schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that any bits of the result can serve as a hash."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Memory:
    """What a worker made lately, by key. At `limit` entries, those not asked for since the last time are forgotten."""

    def __init__(self, limit: int) -> None:
        self.now: dict = {}
        self.before: dict = {}
        self.limit = limit

    def missing(self, keys: set) -> set:
        """The keys that are to be made anew and put into `now`; the others are there after the call."""
        if len(self.now) > self.limit:
            self.before, self.now = self.now, {}
        lack = keys.difference(self.now)
        if self.before:
            kept = lack & self.before.keys()
            self.now.update((k, self.before[k]) for k in kept)
            lack -= kept
        return lack


def whole_groups(batches: Iterator[pa.RecordBatch], key: Callable[[pa.Table], np.ndarray], rows: int = 200_000) -> Iterator[pa.Table]:
    """Sorted batches joined into tables that end where a key ends. A key with more rows than `rows` comes whole."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        keys = key(table)
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        count = table.num_rows - cut
    if count:
        yield pa.Table.from_batches(held)


def as_long(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64, copy=False).view(np.int64)


def as_unsigned(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int64, copy=False).view(np.uint64)
