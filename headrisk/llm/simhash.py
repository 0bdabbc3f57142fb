"""Near duplicates by SimHash, found with tables of distances to reference fingerprints.

A fingerprint bit is 1 if it is set in more than half of the XXH64 hashes (seed 42) of a text's word shingles. Fingerprints link
at `MAX_BITS` or fewer differing bits; components of linked fingerprints are the groups of near duplicates.

Rows with one fingerprint are one node, so copies cost nothing. To bring nodes together without comparing all of them, the 64 bits are cut into
m stretches: links differ in at most MAX_BITS of them, so they agree in some choice of m - MAX_BITS. Each node
goes to the cell of each choice; m grows with the number of nodes, which keeps chance cells small at any size. Within a cell, every
node has its row of a pivot table, the Hamming distances to `PIVOTS` reference fingerprints. Two nodes whose rows differ by more than MAX_BITS in
any coordinate cannot link (triangle inequality) and are discarded; the survivors are verified bit by bit. Cells with many nodes
are searched outward from one node at a time, which only looks at nodes not reached yet, and give a link for each node
reached, never all pairs. Components come from repeated star contraction on the links, each round written to the shared folder.

Nulls: a null text has no words and fingerprint zero; a null id takes part as the smallest id and comes back as null. Repeated rows are in
one component. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from headrisk.llm.common import as_came, as_long, as_unsigned, bounded_batches, carried, doc_key, from_key, mixed, saved, whole_groups

SHINGLE = 4
MAX_BITS = 4
SEED = 42
PIVOTS = 24
#: Reference fingerprints: a fixed pseudo-random set.
REFERENCES = mixed(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Most nodes that chance should bring to a cell, on average.
CELL = 64
#: Cells up to this size are compared pair by pair, larger ones searched.
SMALL_CELL = 128
_HASHES_AT_ONCE = 65536


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist())
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _HASHES_AT_ONCE):
        ones += np.unpackbits(hashes[i:i + _HASHES_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(as_long(np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64)))

    return of


def stretches(n_nodes: int, max_bits: int = MAX_BITS) -> int:
    """The least m for which cells hold about CELL nodes by chance."""
    m = max_bits + 1
    while m < 2 * max_bits and n_nodes > CELL * 2.0 ** (64 * (m - max_bits) / m):
        m += 1
    return m


def cells(fps: np.ndarray, m: int, max_bits: int = MAX_BITS) -> np.ndarray:
    """A column of cell keys for each choice of the stretches that have to agree."""
    borders = [64 * i // m for i in range(m + 1)]
    masks = [np.uint64(((1 << (b - a)) - 1) << a) for a, b in zip(borders, borders[1:])]
    out = np.empty((len(fps), comb(m, max_bits)), np.uint64)
    for i, chosen in enumerate(combinations(range(m), m - max_bits)):
        mask = np.bitwise_or.reduce([masks[j] for j in chosen])
        out[:, i] = mixed((fps & mask) + mixed(np.full(1, i + 1, np.uint64)))
    return out


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances to the references, a row for each of them."""
    return np.array([np.bitwise_count(fps ^ p) for p in REFERENCES], np.int8)


def linked(fps: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which of the pairs (a, b) of places link: those left by every pivot, then verified."""
    left = np.arange(len(a))
    for row in table:
        left = left[np.abs(row[a[left]] - row[b[left]]) <= max_bits]
    good = np.zeros(len(a), bool)
    good[left] = np.bitwise_count(fps[a[left]] ^ fps[b[left]]) <= max_bits
    return good


def _searched(fps: np.ndarray, table: np.ndarray, lo: int, hi: int, max_bits: int) -> list[np.ndarray]:
    """Links that connect what is connected among the places lo to hi."""
    rest, out = np.arange(lo, hi), []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            hit = linked(fps, table, np.full(len(rest), x), rest, max_bits)
            if hit.any():
                out.append(np.stack([np.full(int(hit.sum()), x), rest[hit]]))
                front.extend(rest[hit].tolist())
                rest = rest[~hit]
    return out


def cell_links(cell: np.ndarray, fps: np.ndarray, max_bits: int) -> np.ndarray:
    """Pairs of places that link, for nodes sorted by cell."""
    table, found = pivot_table(fps), []
    borders = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
    sizes = np.diff(borders)
    small = np.repeat(sizes <= SMALL_CELL, sizes)
    for d in range(1, SMALL_CELL):
        a = np.flatnonzero((cell[:-d] == cell[d:]) & small[:-d]) if d < len(cell) else np.zeros(0, np.int64)
        if not len(a):
            break
        good = linked(fps, table, a, a + d, max_bits)
        found.append(np.stack([a[good], a[good] + d]))
    for i in np.flatnonzero(sizes > SMALL_CELL):
        found.extend(_searched(fps, table, borders[i], borders[i + 1], max_bits))
    return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a, b: links that connect whatever is connected among the distinct fingerprints of a saved column fp."""
    m = stretches(nodes.count(), max_bits)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = as_unsigned(batch.column(0).to_numpy())
            keys = cells(fps, m, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(as_long(keys.ravel())), pa.array(as_long(np.repeat(fps, keys.shape[1])))], names=["cell", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, lambda t: t.column("cell").to_numpy()):
            fps = as_unsigned(group.column("fp").to_numpy())
            a, b = cell_links(group.column("cell").to_numpy(), fps, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(as_long(fps[a])), pa.array(as_long(fps[b]))], names=["a", "b"])

    dealt = nodes.select("fp").mapInArrow(deal, "cell long, fp long").repartition("cell").sortWithinPartitions("cell", "fp")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of the links with the smallest node it is connected to."""
    def both_ways(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, small: bool) -> DataFrame:
        """Each node's larger (or smaller) neighbours are linked to the smallest node around it."""
        around = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")) if small else both_ways(e)
        least = around.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        moved = around.join(least, F.col("a") == F.col("k")).where(F.lit(True) if small else F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        if small:
            moved = moved.union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
        return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    edges, before = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        edges = saved(star(star(edges, small=False), small=True), "stars")
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def _grouped(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """doc, fp and component, with ids as keys."""
    bounded_batches(docs.sparkSession)
    marked = saved(docs.select(doc_key().alias("doc"), _fingerprints(shingle)("text").alias("fp")), "simhash")
    nodes = saved(marked.groupBy("fp").agg(F.min("doc").alias("first")), "simhash-nodes")
    roots = components(links(nodes, max_bits))
    rooted = saved(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(firsts, "root").select(F.col("fp").alias("own_fp"), "root", "component")
    return marked.join(named, F.col("fp") == F.col("own_fp")).select("doc", "fp", "root", "component")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp and component: the smallest id that is reachable. One row for each row."""
    return _grouped(docs, shingle, max_bits).select(from_key("doc").alias("doc_id"), "fp", from_key("component").alias("component"))


def keep_first(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component, the one with the smallest id, with its columns. Where rows share that id, one with the least fingerprint stays."""
    bounded_batches(docs.sparkSession)
    groups = saved(_grouped(docs, shingle, max_bits), "simhash-groups")
    shared = groups.groupBy("doc").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc").alias("_shared"))
    firsts = groups.groupBy("root").agg(F.min(F.struct("doc", "fp")).alias("x")).select(F.col("x.doc").alias("_first"), F.col("x.fp").alias("_fp"))
    firsts = firsts.join(shared, F.col("_first") == F.col("_shared"), "left").select("_first", "_fp", F.col("_shared").isNotNull().alias("_many"))
    used = ["doc_id", "text"]
    kept = carried(docs, used).withColumn("_key", doc_key()).join(firsts, F.col("_key") == F.col("_first"))
    # only rows that share their id need a look at their text
    kept = kept.withColumn("_own", _fingerprints(shingle)(F.when(F.col("_many"), F.col("text")))).where("NOT _many OR _own = _fp")
    kept = kept.withColumn("_row", F.row_number().over(W.partitionBy("_key", "_fp").orderBy(F.lit(0)))).where("_row = 1")
    return as_came(kept, docs, used)
