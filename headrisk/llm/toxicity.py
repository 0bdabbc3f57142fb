"""Toxicity from two Kneser-Ney bigram models, one of toxic and one of ordinary texts.

Training texts are the labelled documents of folds 2 to 4 (crc32 of the id as text, mod 5); fold 1 sets the scale of the score and fold 0 is held out.
All words and word pairs of all training texts are counted, by class, and those met `LEAST` times in a class have an entry of their own, however large the
corpus is: a rarer word is as good as unseen, a rarer pair backs off. In both orders a class keeps its counts less a discount, and gives the rest
of its mass to the next lower order; the lowest is shared: the continuation counts (distinct words before a word) of both classes together.

The model is a table of hashes of words and pairs with what they say for one class, and grows with the corpus. Texts stay where they are read: the at most
`HOT` entries counted most often are broadcast, and each task resolves with them what it can. All other entries have a Bloom filter of at most
`FILTER_BYTES`, also broadcast. Only places of a text that the filter cannot clear ask for their entries, by a join; what the filter lets through wrongly finds
nothing there, so scores do not depend on how many entries either bound holds.

A text's score compares the mean log-likelihoods per word, of all words and of those that speak for one class by more than `STRONG`: toxic texts are mostly
ordinary, and the many small differences of their other words would hide the few large ones. A logistic function of both differences and of the length
turns them into a probability; it is fitted on at most `SCALE_ROWS` labelled texts of fold 1, those with the smallest hash of their id.

Nulls: a null text is empty, and an empty text gets the score of no evidence; a label that is null is no label; a null id counts as the empty id. Repeated rows
get equal scores. Without labelled texts of both classes every score is the share of toxic labels (0 if there are none). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from headrisk.llm.common import MULTIPLIER, as_long, as_unsigned, bounded_batches, mixed, saved, whole_groups

LEAST = 3
DISCOUNT = 0.75
SCALE_ROWS = 20_000
STRONG = 2.0
#: Entries that every task holds, the most frequent: 16 bytes each.
HOT = 2_000_000
#: Entries that a task packs into one row for the driver, about.
SLICE_ENTRIES = 1 << 12
#: Most bytes of the filter of all other entries, and those of one of its segments.
FILTER_BYTES = 16 << 20
SEGMENT_BYTES = 64 << 10
#: Bits of the filter for each name and probes into them, as long as FILTER_BYTES allow.
NAME_BITS = 16
PROBES = 6
#: Words that a task counts together.
COUNT_WORDS = 2_000_000
#: Copies of the words' table, so that the pairs of a common word meet it in many tasks.
COPIES = 16
#: ASCII marks count as spaces, A-Z as a-z.
_PLAIN = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def plain_words(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def fold(doc_id: F.Column) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def _press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press.compress((t.as_py() or "").encode()) for t in batch.column(1)], pa.binary())], names=["id", "pressed"])


def given_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic and fold of the labels that are not held out."""
    given = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    return given.withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """id, pressed text, toxic and fold of the labelled documents that are not held out."""
    given = given_labels(labels)
    texts = docs.where("doc_id IS NOT NULL").where(fold(F.col("doc_id")) != 0).select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(_press, "id long, pressed binary")
    return saved(texts.join(given, texts.id == given.doc_id).select("id", "pressed", "toxic", "fold"), "labelled")


def word_names(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def pair_names(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * MULTIPLIER + second)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[np.ndarray]]]:
    """The names of the words of the texts, ordinary and toxic, a few million words at a time."""
    unpress, found, size = zstandard.ZstdDecompressor(), [[], []], 0
    for batch in batches:
        for text, toxic in zip(batch.column("pressed"), batch.column("toxic").to_pylist()):
            found[toxic].append(word_names(plain_words(unpress.decompress(text.as_py()))))
            size += len(found[toxic][-1])
            if size >= COUNT_WORDS:
                yield found
                found, size = [[], []], 0
    if size:
        yield found


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts by class, and those as the first of a pair."""
    for found in _counted(batches):
        for toxic, texts in enumerate(found):
            texts = [x for x in texts if len(x)]
            if not texts:
                continue
            words, at, n = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
            lasts = np.bincount(at[np.cumsum([len(x) for x in texts]) - 1], minlength=len(words))
            own, none = (n, n - lasts), (np.zeros(len(n), np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (as_long(words), *(none if toxic else own), *(own if toxic else none))],
                                             names=["word", "ordinary", "context_ordinary", "toxic", "context_toxic"])


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their counts, those of toxic texts in the upper half of n; sorted by the second word, so that the rows of one stand together in the shuffle and pack well."""
    for found in _counted(batches):
        first, second = (np.concatenate([x[s] for texts in found for x in texts]) for s in (slice(None, -1), slice(1, None)))
        n = np.repeat(np.array([1, 1 << 32]), [sum(max(len(x) - 1, 0) for x in texts) for texts in found])
        order = np.lexsort((first, second))
        first, second, n = first[order], second[order], n[order]
        new = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]) if len(n) else np.zeros(0, np.int64)
        if len(new):
            yield pa.RecordBatch.from_arrays([pa.array(as_long(second[new])), pa.array(as_long(first[new])), pa.array(np.add.reduceat(n, new))], names=["second", "first", "n"])


def _merge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by both words: how many distinct pairs end in a word (first is null), and the pairs met LEAST times in a class."""
    held = np.zeros((4, 0), np.int64)

    def done(pairs: np.ndarray) -> pa.RecordBatch:
        ends, n = np.unique(pairs[0], return_counts=True)
        often = pairs[:, (pairs[2:] >= LEAST).any(axis=0)]
        none, is_end = np.zeros(len(ends), np.int64), np.arange(len(ends) + often.shape[1]) < len(ends)
        columns = [np.r_[ends, often[0]], np.r_[none, often[1]], np.r_[n, np.zeros(often.shape[1], np.int64)], np.r_[none, often[2]], np.r_[none, often[3]]]
        return pa.RecordBatch.from_arrays([pa.array(c, mask=is_end) if i == 1 else pa.array(c) for i, c in enumerate(columns)], names=["second", "first", "before", "ordinary", "toxic"])

    for batch in batches:
        second, first, n = (batch.column(c).to_numpy() for c in ("second", "first", "n"))
        rows = np.concatenate([held, np.stack([second, first, n & 0xFFFFFFFF, n >> 32])], axis=1)
        if not rows.shape[1]:
            continue
        new = np.flatnonzero(np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)])
        pairs = np.concatenate([rows[:2, new], np.add.reduceat(rows[2:], new, axis=1)])
        if len(new) > 1:
            yield done(pairs[:, :-1])
        held = pairs[:, -1:]
    if held.shape[1]:
        yield done(held)


class Model:
    """The two distributions in plain arrays, for vocabularies that fit in memory: log-probabilities of both classes (row 0 ordinary, row 1 toxic)
    for words, and for pairs with an entry."""

    def __init__(self, vocabulary: np.ndarray, words: np.ndarray, before: np.ndarray, context: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray) -> None:
        """words, context: counts by class and place, as a word and as the first of a pair; before: distinct words before a word."""
        self.vocabulary, self.pairs, self.size = vocabulary, pairs, len(vocabulary) + 1
        shared = (before + 1.0) / (before + 1.0).sum()
        total = np.maximum(words.sum(axis=1, keepdims=True), 1)
        own = np.maximum(words - DISCOUNT, 0) / total
        self.uni = own + (1 - own.sum(axis=1, keepdims=True)) * shared
        base = np.maximum(context, 1)[:, pairs // self.size]
        kept = np.maximum(pair_counts - DISCOUNT, 0) / base
        left = np.stack([1 - np.bincount(pairs // self.size, weights=kept[c], minlength=self.size) for c in (0, 1)])
        self.left = np.log(np.maximum(left, 1e-9))
        self.pair_log = np.log(kept + np.maximum(left, 1e-9)[:, pairs // self.size] * self.uni[:, pairs % self.size])
        self.uni_log = np.log(self.uni)


def train(texts: DataFrame) -> tuple[DataFrame, float]:
    """name, word_gap, left and n of the words and pairs with an entry, and the word_gap of all other words.

    word_gap is the log-probability, toxic less ordinary, of a word or of a pair's second word after the first; left, null for pairs, is that of backing off after a word;
    n is the number of times it was met."""
    texts = texts.select("pressed", "toxic")
    words = saved(texts.mapInArrow(_count_words, "word long, ordinary long, context_ordinary long, toxic long, context_toxic long")
                  .groupBy("word").agg(*[F.sum(c).alias(c) for c in ("ordinary", "toxic", "context_ordinary", "context_toxic")]), "toxicity-words")
    merged = saved(texts.mapInArrow(_count_pairs, "second long, first long, n long").repartition("second", F.pmod("first", F.lit(COPIES)))
                   .sortWithinPartitions("second", "first").mapInArrow(_merge_pairs, "second long, first long, before long, ordinary long, toxic long"), "toxicity-pairs")
    often = (F.col("ordinary") >= LEAST) | (F.col("toxic") >= LEAST)
    own = {c: F.when(often, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))).otherwise(0.0) for c in ("ordinary", "toxic")}
    ends, pairs = merged.where("first IS NULL"), merged.where("first IS NOT NULL")
    of = words.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(x), F.lit(0)).alias(k) for k, x in
                                              [("ordinary", F.col("ordinary")), ("toxic", F.col("toxic")), ("own_ordinary", own["ordinary"]), ("own_toxic", own["toxic"])]]).first()
    places = (ends.agg(F.sum("before")).first()[0] or 0) + of.n + 1
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    sums = ["ordinary", "toxic", "before", "context_ordinary", "context_toxic", "kept_ordinary", "kept_toxic"]
    row = lambda word, *values: [F.col(word).alias("word"), *[v.alias(k) for k, v in zip(sums, values)]]
    parts = (words.where(often).select(row("word", F.col("ordinary"), F.col("toxic"), zero, F.col("context_ordinary"), F.col("context_toxic"), none, none))
             .union(ends.select(row("second", zero, zero, F.col("before"), zero, zero, none, none)))
             .union(pairs.select(row("first", zero, zero, zero, zero, zero, own["ordinary"], own["toxic"]))))
    known = parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in sums]).where(often)
    rest = {}
    for c in ("ordinary", "toxic"):
        total, rest[c] = max(of[c], 1), 1 - of[f"own_{c}"] / max(of[c], 1)
        known = known.withColumn(f"uni_{c}", own[c] / total + (F.col("before") + 1.0) / places * rest[c])
        known = known.withColumn(f"context_{c}", F.greatest(f"context_{c}", F.lit(1)))
        known = known.withColumn(f"left_{c}", F.greatest(1 - F.col(f"kept_{c}") / F.col(f"context_{c}"), F.lit(1e-9)))
    known = saved(known.drop("before", "kept_ordinary", "kept_toxic"), "toxicity-known")

    gap = lambda x: F.log(x("toxic")) - F.log(x("ordinary"))
    copied = known.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))).drop("ordinary", "toxic")
    often_pairs = pairs.drop("before").withColumn("salt", F.pmod(F.xxhash64("first", "second"), F.lit(COPIES)).cast("int"))
    firsts = copied.select(F.col("word").alias("w1"), F.col("copy").alias("c1"), "context_ordinary", "context_toxic", "left_ordinary", "left_toxic")
    seconds = copied.select(F.col("word").alias("w2"), F.col("copy").alias("c2"), "uni_ordinary", "uni_toxic")
    joined = (often_pairs.join(firsts, (F.col("first") == F.col("w1")) & (F.col("salt") == F.col("c1")))
              .join(seconds, (F.col("second") == F.col("w2")) & (F.col("salt") == F.col("c2"))))
    of_pair = lambda c: own[c] / F.col(f"context_{c}") + F.col(f"left_{c}") * F.col(f"uni_{c}")
    entries = (known.select(F.col("word").alias("name"), gap(lambda c: F.col(f"uni_{c}")).alias("word_gap"), gap(lambda c: F.col(f"left_{c}")).alias("left"), (F.col("ordinary") + F.col("toxic")).alias("n"))
               .union(joined.select(_pair_name("first", "second"), gap(of_pair), F.lit(None).cast("double"), F.col("ordinary") + F.col("toxic"))))
    return saved(entries, "toxicity-entries"), float(np.log(max(rest["toxic"], 1e-9)) - np.log(max(rest["ordinary"], 1e-9)))


@F.arrow_udf(T.LongType())
def _pair_name(first: pa.Array, second: pa.Array) -> pa.Array:
    return pa.array(as_long(pair_names(as_unsigned(first.to_numpy()), as_unsigned(second.to_numpy()))))


def _rank(n: F.Column) -> F.Column:
    """Counts in steps of a fifth or less, few enough to be counted on the driver."""
    return F.when(n < 16, n).otherwise(F.floor(4 * F.log2(n))).cast("int")


def _slices(total: int) -> int:
    """Bits of a name that number its slice, so that a slice has about SLICE_ENTRIES of so many names."""
    return max((total // SLICE_ENTRIES).bit_length(), 1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From entries sorted by slice: each slice as one row, its names in order with their two values."""
    for table in whole_groups(batches, lambda t: t.column("slice").to_numpy(), SLICE_ENTRIES):
        slices, names = table.column("slice").to_numpy(), as_unsigned(table.column("name").to_numpy())
        values = [table.column(c).to_numpy().astype(np.float32) for c in ("word_gap", "left")]
        order = np.argsort(names)
        borders = np.flatnonzero(np.r_[True, slices[1:] != slices[:-1], True])
        for i, j in zip(borders, borders[1:]):
            own = order[i:j]
            yield pa.RecordBatch.from_arrays([pa.array([slices[i]], pa.int32()), *[pa.array([x[own].tobytes()], pa.binary()) for x in (names, *values)]],
                                             names=["slice", "names", "gaps", "lefts"])


def hot_entries(entries: DataFrame, most: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """The entries of the highest ranks, at most so many in all, sorted by name, and the least rank among them.

    Tasks sort and pack them, and they reach the driver a part at a time, straight to their places: it never holds them twice."""
    least, total = 1 << 20, 0
    for r in sorted(entries.groupBy(_rank(F.col("n")).alias("rank")).agg(F.count("*").alias("rows")).collect(), reverse=True):
        if total + r.rows > most:
            break
        least, total = r["rank"], total + r.rows
    out = np.empty(total, np.uint64), np.empty(total, np.float32), np.empty(total, np.float32)
    if not total:
        return out, least
    bits = _slices(total)
    some = entries.where(_rank(F.col("n")) >= least).select(F.shiftrightunsigned("name", 64 - bits).cast("int").alias("slice"), "name", "word_gap", "left")
    packed = saved(some.repartition("slice").sortWithinPartitions("slice").mapInArrow(_pack, "slice int, names binary, gaps binary, lefts binary"), "toxicity-hot")
    sizes = {r["slice"]: r.size for r in packed.select("slice", (F.octet_length("names") / 8).cast("int").alias("size")).collect()}
    ends = dict(zip(sorted(sizes), np.cumsum([sizes[k] for k in sorted(sizes)]).tolist()))
    for r in packed.toLocalIterator():
        for column, values in zip(out, (r.names, r.gaps, r.lefts)):
            column[ends[r["slice"]] - sizes[r["slice"]]:ends[r["slice"]]] = np.frombuffer(values, column.dtype)
    return out, least


def _probes(names: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment of each name and, a row for each probe, its bits there."""
    bits, hashes = np.uint64(8 * SEGMENT_BYTES), mixed(names)
    start, step = hashes >> np.uint64(32), hashes & np.uint64(0xFFFFFFFF) | np.uint64(1)
    return (names % np.uint64(segments)).astype(np.int64), np.stack([(start + np.uint64(i) * step) % bits for i in range(PROBES)]).astype(np.int64)


def tail_filter(entries: DataFrame, most_bytes: int) -> np.ndarray:
    """A Bloom filter of names, a row for each segment: NAME_BITS for each name, but no more than `most_bytes` in all."""
    n = entries.count()
    segments = int(min(max(-(-NAME_BITS * n // (8 * SEGMENT_BYTES)), 1), max(most_bytes // SEGMENT_BYTES, 1)))
    out = np.zeros((segments, SEGMENT_BYTES), np.uint8)
    if not n:
        return out

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of names sorted by segment."""
        now, bits = None, np.zeros(8 * SEGMENT_BYTES, bool)
        give = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["segment", "bits"])
        for batch in batches:
            segment, at = _probes(as_unsigned(batch.column("name").to_numpy()), segments)
            borders = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1], True]) if len(segment) else []
            for i, j in zip(borders, borders[1:]):
                if now is not None and segment[i] != now:
                    yield give()
                    bits[:] = False
                now = int(segment[i])
                bits[at[:, i:j].ravel()] = True
        if now is not None:
            yield give()

    split = entries.select("name", _segment(segments)("name").alias("segment")).repartition("segment").sortWithinPartitions("segment")
    for r in saved(split.mapInArrow(fill, "segment long, bits binary"), "toxicity-filter").toLocalIterator():
        out[r.segment] = np.frombuffer(r.bits, np.uint8)
    return out


def _segment(segments: int):
    @F.arrow_udf(T.LongType())
    def of(names: pa.Array) -> pa.Array:
        return pa.array((as_unsigned(names.to_numpy()) % np.uint64(segments)).astype(np.int64))

    return of


def _held(names: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Which names the filter may hold."""
    segment, at = _probes(names, len(filled))
    out = np.ones(len(names), bool)
    for row in at:
        out &= (filled[segment, row >> 3] >> (7 - (row & 7)) & 1).astype(bool)
    return out


def _look(asked: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the asked in sorted names, and which are there."""
    if not len(names):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    where = np.minimum(np.searchsorted(names, asked), len(names) - 1)
    return where, names[where] == asked


#: What is asked for at a place: the word's own value, that of backing off after it for the next place, both, or the pair's value.
WORD, NEXT, BOTH, PAIR = 0, 1, 2, 3


def resolved(names: np.ndarray, hot: tuple[np.ndarray, np.ndarray, np.ndarray], filled: np.ndarray, other: float) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """The log-likelihood of each word of a text, toxic less ordinary, which of them wait for an answer, and what is asked for: kind, places and names.

    The first row is a word's own value and the second that of backing off after the word before, each as if what is asked for did not exist."""
    out = np.zeros((2, len(names)))
    if not len(names):
        return out, np.zeros(0, bool), []
    distinct, at = np.unique(names, return_inverse=True)
    where, hit = _look(distinct, hot[0])
    own, left = np.full(len(distinct), other), np.zeros(len(distinct))
    own[hit], left[hit] = hot[1][where[hit]], hot[2][where[hit]]
    maybe = ~hit
    maybe[maybe] = _held(distinct[maybe], filled)
    out[0], out[1, 1:] = own[at], left[at][:-1]
    asked = maybe[at]
    # a pair has an entry only where both words have one
    known = (hit | maybe)[at]
    both = 1 + np.flatnonzero(known[:-1] & known[1:])
    pairs = pair_names(names[both - 1], names[both])
    where, found = _look(pairs, hot[0])
    out[:, both[found]] = np.stack([hot[1][where[found]], np.zeros(int(found.sum()))])
    settled = np.zeros(len(names), bool)
    settled[both[found]] = True
    of_word, of_next = asked & ~settled, np.r_[asked[:-1] & ~settled[1:], False]
    rest = ~found
    rest[rest] = _held(pairs[rest], filled)
    waits = of_word | np.r_[False, of_next[:-1]]
    waits[both[rest]] = True
    some = np.flatnonzero(of_word | of_next)
    kinds = np.where(of_word[some], np.where(of_next[some], BOTH, WORD), NEXT)
    return out, waits, [(kinds, some, names[some]), (np.full(int(rest.sum()), PAIR), both[rest], pairs[rest])]


ROWS = "kind int, row long, doc_id {}, total double, strong double, n long, place long, own float, back float, ask long, name long"
DOCUMENT, WAITING, ASKING = 0, 1, 2


def _measure(shared, other: float, schema: pa.Schema):
    """Documents with the sums of their settled words; places that wait for an answer; and the names that are asked for.

    Places are numbered by task and order, so the next place has the next number; `ask` is four times the place's number plus what is asked for."""
    def rows_of(kind: int, size: int, **columns) -> pa.RecordBatch:
        columns["kind"] = np.full(size, kind, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, filled = shared.value
        row = place = TaskContext.get().partitionId() << 40
        for batch in batches:
            docs, waiting, asking = [], [], []
            for t in batch.column("text"):
                names = word_names(plain_words((t.as_py() or "").encode()))
                out, waits, asked = resolved(names, hot, filled, other)
                values, late = out.sum(axis=0)[~waits], np.flatnonzero(waits)
                docs.append((row, float(values.sum()), float(np.maximum(values - STRONG, 0).sum()), len(names)))
                if len(late):
                    waiting.append((np.full(len(late), row), place + late, *out[:, late].astype(np.float32)))
                    asking.extend(((place + places << 2) + kinds, as_long(wanted)) for kinds, places, wanted in asked)
                row, place = row + 1, place + len(names)
            if docs:
                yield rows_of(DOCUMENT, len(docs), doc_id=batch.column("doc_id"), **dict(zip(("row", "total", "strong", "n"), zip(*docs))))
            if waiting:
                columns = [np.concatenate(x) for x in zip(*waiting)]
                yield rows_of(WAITING, len(columns[0]), **dict(zip(("row", "place", "own", "back"), columns)))
                columns = [np.concatenate(x) for x in zip(*asking)]
                yield rows_of(ASKING, len(columns[0]), **dict(zip(("ask", "name"), columns)))

    return run


def measured(docs: DataFrame, entries: DataFrame, other: float, hot: int = HOT, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """doc_id, difference (mean log-likelihood per word, toxic less ordinary), strong (the sum of what single words have beyond STRONG) and n (words) of each document."""
    spark = docs.sparkSession
    # values travel as floats, so that an entry says the same wherever it is held
    entries, other = entries.select("name", F.col("word_gap").cast("float"), F.col("left").cast("float"), "n"), float(np.float32(other))
    known, least = hot_entries(entries, hot)
    tail = entries.where(_rank(F.col("n")) < least)
    shared = spark.sparkContext.broadcast((known, tail_filter(tail, filter_bytes)))
    del known
    layout = T._parse_datatype_string(ROWS.format(docs.schema["doc_id"].dataType.simpleString()))
    rows = saved(docs.select("doc_id", "text").mapInArrow(_measure(shared, other, to_arrow_schema(layout)), layout), "toxicity-rows")

    asked = rows.where(F.col("kind") == ASKING).select("ask", "name")
    answers = asked.join(tail.select(F.col("name").alias("known"), "word_gap", "left"), F.col("name") == F.col("known"))
    place, what, none = F.shiftright("ask", 2), F.col("ask").bitwiseAND(3), F.lit(None).cast("float")
    answer = lambda at, word, back, pair: F.struct(at.alias("place"), word.alias("word"), back.alias("after"), pair.alias("pair"))
    given = F.array(answer(place, F.when(what.isin(WORD, BOTH), F.col("word_gap")), none, F.when(what == PAIR, F.col("word_gap"))),
                    answer(place + 1, none, F.when(what.isin(NEXT, BOTH), F.col("left")), none))
    wanted = F.when(what == BOTH, given).when(what == NEXT, F.slice(given, 2, 1)).otherwise(F.slice(given, 1, 1))
    given = answers.select(F.explode(wanted).alias("a")).select("a.*")
    waiting = rows.where(F.col("kind") == WAITING).select("place", none.alias("word"), none.alias("after"), none.alias("pair"), "row", "own", "back")
    places = (waiting.unionByName(given, allowMissingColumns=True).groupBy("place")
              .agg(*[F.max(c).alias(c) for c in ("row", "word", "after", "pair", "own", "back")]).where("row IS NOT NULL"))
    value = F.coalesce("pair", F.coalesce("word", "own").cast("double") + F.coalesce("after", "back").cast("double"))
    late = places.groupBy("row").agg(F.sum(value).alias("late"), F.sum(F.greatest(value - STRONG, F.lit(0.0))).alias("late_strong")).withColumnRenamed("row", "late_row")
    whole = rows.where(F.col("kind") == DOCUMENT).join(late, F.col("row") == F.col("late_row"), "left")
    return whole.select("doc_id", ((F.col("total") + F.coalesce("late", F.lit(0.0))) / F.greatest("n", F.lit(1))).alias("difference"),
                        (F.col("strong") + F.coalesce("late_strong", F.lit(0.0))).alias("strong"), "n")


FEATURES = ["difference", "strong", "strong_share", "length"]


def features(m: str) -> list[F.Column]:
    """The columns that the score depends on, from a measure."""
    n, strong = F.col(f"{m}.n"), F.col(f"{m}.strong")
    return [F.col(f"{m}.difference"), F.log1p(strong), strong / F.greatest(n, F.lit(1)), F.log1p(n)]


def fit_scale(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method, with a small penalty."""
    middle, spread = x.mean(axis=0), x.std(axis=0)
    middle[0], spread = 0, np.where(spread > 1e-12, spread, 1)
    z, w = (x - middle) / spread, np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 0.1 * np.eye(len(w)), z.T @ (y - p) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    w = w / spread
    w[0] -= (w[1:] * middle[1:]).sum()
    return w


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and the difference that the score comes from."""
    bounded_batches(docs.sparkSession)
    texts = labelled(docs, labels)
    shares = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    held_out = (fold(F.col("doc_id")) == 0).alias("held_out")
    if len(shares) < 2:
        known = float(max(shares, default=0))
        return docs.select("doc_id", held_out, F.lit(known).alias("score"), F.lit(int(known >= 0.5)).alias("predicted"), F.lit(0.0).alias("difference"))
    scored = saved(measured(docs, *train(texts.where("fold > 1"))).select("doc_id", F.struct("difference", "strong", "n").alias("m")), "toxicity-measures")
    given = given_labels(labels).where("fold = 1").select(F.col("doc_id").alias("id"), "toxic")
    some = (scored.join(given, F.col("doc_id") == F.col("id")).orderBy(F.xxhash64(F.col("doc_id").cast("long"))).limit(SCALE_ROWS)
            .select(*[c.cast("double").alias(k) for k, c in zip(FEATURES, features("m"))], F.col("toxic").cast("double").alias("toxic")).toArrow())
    toxic = some.column("toxic").to_numpy()
    if len(np.unique(toxic)) == 2:
        weights = fit_scale(np.column_stack([np.ones(len(toxic)), *[some.column(k).to_numpy() for k in FEATURES]]), toxic)
    else:
        weights = np.array([np.log(shares[1] / shares[0]), 1.0, 0, 0, 0])
    z = F.lit(float(weights[0]))
    for w, c in zip(weights[1:], features("m")):
        z = z + c * float(w)
    score = F.lit(1.0) / (1 + F.exp(-z))
    return scored.select("doc_id", held_out, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col("m.difference").alias("difference"))
