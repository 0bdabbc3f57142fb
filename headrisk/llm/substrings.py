"""Substring dedup: passages of `WINDOW` words or more that also start earlier are removed.

The suffixes of all texts, as sequences of words, form a suffix tree of which only the part WINDOW words deep decides: an inner node there is a
window that occurs twice, and its leaves are the starts. The tree is never in one place. It is built by
prefixes in two steps, and a node is named by a hash of the words on its path:

1. Every window holds one marked start, the one of its `PREFIX`-word grams that has the least hash, so equal windows have equal marks. The marked
   suffixes, about one in seven, are dealt out by their PREFIX-word prefix. A prefix with one suffix has no inner node below it, and is left out.
2. Only the windows of the marks that are left are followed to full depth: their starts are dealt out by the longer prefix, all WINDOW words, so
   the groups are small; sorted by name, place and check hash, each group is a subtree whose inner nodes are runs of one name. All leaves but the first
   are repeats, which go back to their documents and are joined to maximal stretches there.

A task tells by itself that a prefix or a window occurs again within one of its batches, and sends one suffix in place of the many: a passage that
a third of all documents hold costs its group a row for each batch. Documents with one sequence of words are found along with the marks: all but the
first are repeats from end to end, and their windows are not sent. Names have 96 bits, those of documents 124.

Order is by id, then by place. Nulls: a null text has no words; a null id sorts first. Rows that share an id count as one place in that order:
neither's window is removed because of the other's at the same start; each is edited by itself, so they go by their id and a hash of their text. Short texts have no window. An empty table gives an empty result.
Extra columns pass through `remove_repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from headrisk.llm.common import MULTIPLIER, as_came, as_long, as_unsigned, bounded_batches, carried, doc_key, mixed, saved, whole_groups

WINDOW = 20
PREFIX = 8
_LOW = np.uint64(0xFFFFFFFF)
_KNOWN = np.uint64(1 << 31)
#: Of the texts on their way between jobs.
_LEVEL = 6


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def grams(x: np.ndarray, length: int) -> np.ndarray:
    """A polynomial hash of each run of `length` values."""
    out = np.zeros(max(0, len(x) - length + 1), np.uint64)
    for j in range(length):
        out = out * MULTIPLIER + x[j: j + len(out)]
    return out


def marks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window its marked start, and for each start the name of its prefix."""
    names = mixed(grams(x, PREFIX))
    within = np.lib.stride_tricks.sliding_window_view(names, WINDOW - PREFIX + 1)
    return np.arange(len(within)) + within.argmin(axis=1), names


def _press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=_LEVEL)
    for batch in batches:
        yield batch.set_column(2, batch.schema.names[2], pa.array([press.compress((t.as_py() or "").encode()) for t in batch.column(2)], pa.binary()))


def _send_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, row, text) to name, doc, row and place of the marked suffixes. Sent: 0 by its name; 1 the same, occurs again here; 2 anywhere, is known to occur again; 3 a document by its name."""
    for batch in batches:
        docs, rows, names, places, wholes = [], [], [], [], []
        for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            words = (text.as_py() or "").encode().split()
            if len(words) >= WINDOW:
                whole = xxhash.xxh3_128_intdigest(b" ".join(words))
                wholes.append((whole & (2**64 - 1), doc, row, (whole >> 68 << 2) + 3))
                at, name = marks(word_hashes(words))
                at = np.unique(at)
                docs.append(np.full(len(at), doc, np.int64))
                rows.append(np.full(len(at), row, np.int64))
                names.append(name[at])
                places.append(at)
        if not docs:
            continue
        doc, row, name, place = map(np.concatenate, (docs, rows, names, places))
        order = np.argsort(name, kind="stable")
        doc, row, name, place = doc[order], row[order], name[order], place[order]
        first = np.r_[True, name[1:] != name[:-1]]
        again = ~first | np.r_[~first[1:], False]
        sent = np.where(first, again, 2).astype(np.int64)
        route = np.where(first, name, mixed(name + as_unsigned(doc) * MULTIPLIER + place.astype(np.uint64)))
        whole = [np.array(x, t) for x, t in zip(zip(*wholes), (np.uint64, np.int64, np.int64, np.uint64))]
        packed = (place.astype(np.int64) * 4 + sent).view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(as_long(np.concatenate([route, whole[0]]))), pa.array(np.concatenate([doc, whole[1]])), pa.array(np.concatenate([row, whole[2]])),
                                          pa.array(as_long(np.concatenate([packed, whole[3]])))], names=["route", "doc", "row", "place"])


def _occur_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The marked suffixes whose prefix has two or more; with place -1, documents that are copies of earlier ones."""
    for table in whole_groups(batches, lambda t: t.column("route").to_numpy()):
        route, doc, row, place = (table.column(c).to_numpy() for c in ("route", "doc", "row", "place"))
        sent = place & 3
        whole = np.flatnonzero(sent == 3)
        if len(whole):
            whole = whole[np.lexsort((doc[whole], place[whole], route[whole]))]
            same = np.r_[False, (route[whole][1:] == route[whole][:-1]) & (place[whole][1:] == place[whole][:-1])]
            first = whole[np.maximum.accumulate(np.where(same, 0, np.arange(len(whole))))]
            copies = whole[doc[whole] != doc[first]]
            yield pa.RecordBatch.from_arrays([pa.array(doc[copies]), pa.array(row[copies]), pa.array(np.full(len(copies), -1))], names=["doc", "row", "place"])
        named = np.flatnonzero(sent < 2)
        borders = np.flatnonzero(np.r_[True, route[named][1:] != route[named][:-1]]) if len(named) else np.zeros(0, np.int64)
        keep = sent == 2
        if len(named):
            sizes = np.diff(np.r_[borders, len(named)])
            keep[named] = np.repeat((sizes > 1) | (np.maximum.reduceat(sent[named], borders) > 0), sizes)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(row[keep]), pa.array(place[keep] >> 2)], names=["doc", "row", "place"])


def _with_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, np.ndarray, np.ndarray]]]]:
    """Batches sorted by doc, row and kind (0: a and b about a document, 1: the document) to each batch with its documents' rows and what is about them."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, row, kind = (batch.column(c).to_numpy() for c in ("_doc", "_row", "_kind"))
        a, b = (c.fill_null(0).to_numpy() for c in (batch.column("_a"), batch.column("_b")))
        borders, out = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (kind[1:] != kind[:-1]), True]), []
        for i, j in zip(borders, borders[1:]):
            if (doc[i], row[i]) != now:
                now, held = (doc[i], row[i]), []
            if kind[i] == 0:
                held.append((a[i:j], b[i:j]))
                continue
            about = [np.concatenate(x) for x in zip(*held)] if held else [np.zeros(0, np.int64)] * 2
            out.extend((k, *about) for k in range(i, j))
        yield batch, out


def _beside(docs: DataFrame, about: DataFrame, about_columns: list[str]) -> DataFrame:
    """Documents (with _doc and _row) and narrow rows about them, brought together in sorted partitions."""
    none, columns = F.lit(None).cast("long"), [c for c in docs.columns if c not in ("_doc", "_row")]
    rows = [F.col(about_columns[2]).alias("_a"), F.col(about_columns[3]).alias("_b") if len(about_columns) > 3 else none.alias("_b")]
    left = docs.select("_doc", "_row", F.lit(1).alias("_kind"), none.alias("_a"), none.alias("_b"), *[F.col(f"`{c}`") for c in columns])
    right = about.select(F.col(about_columns[0]).alias("_doc"), F.col(about_columns[1]).alias("_row"), F.lit(0).alias("_kind"), *rows,
                         *[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema if f.name in columns])
    return left.union(right).repartition("_doc", "_row").sortWithinPartitions("_doc", "_row", "_kind")


def _row_route(doc: np.ndarray, row: np.ndarray) -> np.ndarray:
    return mixed(as_unsigned(doc) + as_unsigned(row) * MULTIPLIER)


def _send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the marks that are left, by name. A window that occurs earlier in the batch is known to be a repeat, and goes to its document's group."""
    unpress = zstandard.ZstdDecompressor()
    for batch, documents in _with_texts(batches):
        ids, own, texts = batch.column("_doc").to_numpy(), batch.column("_row").to_numpy(), batch.column("text")
        docs, rows, names, checks, places, copies = [], [], [], [], [], []
        for i, left, _ in documents:
            if not len(left):
                continue
            x = word_hashes(unpress.decompress(texts[i].as_py()).split())
            if len(x) < WINDOW:
                continue
            if left.min() < 0:
                start = np.unique(np.r_[np.arange(0, len(x) - WINDOW, WINDOW), len(x) - WINDOW])
                copies.append((np.full(len(start), ids[i], np.int64), np.full(len(start), own[i], np.int64), start))
                continue
            at, _ = marks(x)
            asked = np.zeros(len(x), bool)
            asked[left[left < len(x)]] = True
            start = np.flatnonzero(asked[at])
            docs.append(np.full(len(start), ids[i], np.int64))
            rows.append(np.full(len(start), own[i], np.int64))
            names.append(mixed(grams(x, WINDOW))[start])
            checks.append(grams(mixed(x), WINDOW)[start] >> np.uint64(32))
            places.append(start.astype(np.int64))
        if copies:
            doc, row, start = map(np.concatenate, zip(*copies))
            yield pa.RecordBatch.from_arrays([pa.array(as_long(_row_route(doc, row))), pa.array(doc), pa.array(row), pa.array(as_long(start.astype(np.uint64) << np.uint64(32) | _KNOWN))],
                                             names=["route", "doc", "row", "place"])
        if not docs:
            continue
        doc, row, name, check, place = map(np.concatenate, (docs, rows, names, checks, places))
        order = np.lexsort((place, doc, check, name))
        doc, row, name, check, place = doc[order], row[order], name[order], check[order], place[order]
        same = np.r_[False, (name[1:] == name[:-1]) & (check[1:] == check[:-1])]
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(name))))
        repeat = same & ((doc != doc[head]) | (place != place[head]))
        route = np.where(repeat, _row_route(doc, row), name)
        low = np.where(repeat, _KNOWN, np.uint64(0)) | (check >> np.uint64(1))
        yield pa.RecordBatch.from_arrays([pa.array(as_long(route)), pa.array(doc), pa.array(row), pa.array(as_long(place.astype(np.uint64) << np.uint64(32) | low))], names=["route", "doc", "row", "place"])


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, row, start and end of stretches of words to remove: the leaves of inner nodes but each node's first. Neighbours that came by document are joined."""
    for table in whole_groups(batches, lambda t: t.column("route").to_numpy()):
        route, doc, row, packed = (table.column(c).to_numpy() for c in ("route", "doc", "row", "place"))
        packed = as_unsigned(packed)
        place, low = (packed >> np.uint64(32)).astype(np.int64), packed & _LOW
        known = low >> np.uint64(31) == 1
        order = np.lexsort((place, doc, low, route))
        same = np.r_[False, (route[order][1:] == route[order][:-1]) & (low[order][1:] == low[order][:-1])]
        head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        repeat = known.copy()
        repeat[order] |= same & ((doc[order] != doc[head]) | (place[order] != place[head]))
        doc, row, place = doc[repeat], row[repeat], place[repeat]
        if not len(doc):
            continue
        # stretches of what came by document only: which named leaves meet here depends on the number of tasks
        by_name = ~known[repeat]
        order = np.lexsort((place, by_name, row, doc))
        doc, row, place, by_name = doc[order], row[order], place[order], by_name[order]
        breaks = np.r_[True, by_name[1:] | by_name[:-1] | (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (place[1:] > place[:-1] + WINDOW)]
        starts = np.flatnonzero(breaks)
        ends = place[np.r_[starts[1:], len(doc)] - 1] + WINDOW
        yield pa.RecordBatch.from_arrays([pa.array(doc[starts]), pa.array(row[starts]), pa.array(place[starts]), pa.array(ends)], names=["doc", "row", "start", "end"])


def row_name(docs: DataFrame) -> F.Column:
    """Tells rows that share an id apart by their text, the same in every job. Where no two do, it is zero, which costs the shuffles next to nothing."""
    shared = docs.groupBy(doc_key().alias("doc")).agg(F.count("*").alias("n")).where("n > 1")
    return F.xxhash64(doc_key(), "text") if shared.limit(1).count() else F.lit(0).cast("long")


def repeats(docs: DataFrame, row: F.Column) -> DataFrame:
    """doc, row, start, end: stretches of words covered by windows that start earlier too. Stretches of one document may overlap."""
    own = docs.select(doc_key().alias("_doc"), row.alias("_row"), "text")
    sent = own.mapInArrow(_send_marks, "route long, doc long, row long, place long").repartition("route").sortWithinPartitions("route")
    left = sent.mapInArrow(_occur_again, "doc long, row long, place long")
    pressed = own.mapInArrow(_press, "_doc long, _row long, text binary")
    windows = _beside(pressed, left, ["doc", "row", "place"]).mapInArrow(_send_windows, "route long, doc long, row long, place long")
    return windows.repartition("route").sortWithinPartitions("route").mapInArrow(_subtrees, "doc long, row long, start long, end long")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpress = zstandard.ZstdDecompressor()
    for batch, documents in _with_texts(batches):
        if not documents:
            continue
        texts, n_words, n_removed = [], [], []
        column = batch.column("text")
        for i, starts, ends in documents:
            text = unpress.decompress(column[i].as_py())
            words = text.split()
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, np.minimum(starts, len(words)), 1)
            np.add.at(edge, np.minimum(ends, len(words)), -1)
            gone = np.cumsum(edge)[:-1] > 0
            removed = int(gone.sum())
            texts.append((b" ".join([w for w, g in zip(words, gone) if not g]) if removed else text).decode())
            n_words.append(len(words))
            n_removed.append(removed)
        out = batch.take(pa.array([i for i, _, _ in documents])).drop_columns(["_doc", "_row", "_kind", "_a", "_b"])
        out = out.set_column(out.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
        yield out.append_column("_n_words", pa.array(n_words, pa.int64())).append_column("_n_removed", pa.array(n_removed, pa.int64()))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents with what is left of `text` (words joined by one space where any were removed; null becomes empty), _n_words before and _n_removed,
    unless docs has columns of these names, which stay."""
    bounded_batches(docs.sparkSession)
    came, used = docs, ["doc_id", "text"]
    docs = carried(came, used)
    row = row_name(docs)
    found = saved(repeats(docs, row), "repeats")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    fields = [f for f in docs.schema if f.name != "text"]
    long = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    counts = ("_n_words", "_n_removed")
    pressed = docs.select(doc_key().alias("_doc"), row.alias("_row"), "text", *rest).mapInArrow(_press, T.StructType([*long("_doc", "_row"), T.StructField("text", T.BinaryType()), *fields]))
    done = _beside(pressed, found, ["doc", "row", "start", "end"]).mapInArrow(_cut, T.StructType([T.StructField("text", T.StringType()), *fields, *long(*counts)]))
    return as_came(done, came, used, counts)
