"""Spelling variants: words one edit apart, found by k-d trees over letter-count vectors.

A word's vector has its length and how often each of CLASSES letter classes (code point modulo CLASSES) occurs in it. One replaced letter takes at most one
from a count and adds at most one to another, one inserted letter adds one to the length and to a count: an L1 distance of two at most, with a bound on either
direction. A k-d tree over these vectors splits the space into cells; it is fitted on a sample of SAMPLE words or so, by hash, which decides only how even
the cells are, and sized so that a cell has about CELL_WORDS words and there are MAX_CELLS cells or so. Every word lies in one cell and asks the other
cells whose box an edit can reach: boxes of its own length (cells after its own; the earlier ones ask it) and of one letter more. A cell's task builds a tree
for each length over its words, prunes by box, and verifies letter order in the leaves, for words that stream by. What leaves a task is a row for each
word with the number of near words found there and the best of them, never pairs.

A word's form is its near word of largest n (ties: smallest by code point) if that n is at least `ratio` times its own. Roots follow forms by pointer doubling; n grows
`ratio`-fold with each step, so the rounds are few.

Nulls: null and empty words are left out. Repeated words must be counted before. Words of any length are compared whole. An empty table gives an empty
result. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from headrisk.llm.common import bounded_batches, saved

CLASSES = 32
SAMPLE = 65_536
CELL_WORDS = 50_000
MAX_CELLS = 4096
#: Words in a leaf of a cell's tree, words that ask together, and letters that are compared at once.
LEAF_WORDS = 64
ASK_WORDS = 40_000
COMPARED = 4_000_000
#: Pairs that a task holds before it counts them.
PAIRS_HELD = 500_000
RATIO = 10
#: The length's weight among the coordinates: a wrong length is farther than any edit.
_LENGTH = 8

_ROUTED = "cell int, kind int, word string, n long"
_NEAR = "word string, n_near long, best_n long, best string"
OWN, SAME, LONGER = range(3)


def words_of_letters(text: Column, letters: str, least: int) -> Column:
    """The maximal runs of `letters` (a character class) with at least `least` code points, A-Z lower-cased."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[{letters}]{{{least},}}"), F.lit(0))
    return F.transform(runs, lambda w: F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def letters_of(words: list[str], length: int) -> np.ndarray:
    """Words of one length as rows of code points."""
    joined = "".join(words)
    try:
        return np.frombuffer(joined.encode("latin-1"), np.uint8).reshape(-1, length)
    except UnicodeEncodeError:
        return np.frombuffer(joined.encode("utf-32-le"), "<u4").reshape(-1, length)


def vectors(words: list[str]) -> np.ndarray:
    """Weighted length and counts of letter classes, a row for each word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = letters_of(words, 1)[:, 0].astype(np.int64) if words else np.zeros(0, np.int64)
    at = np.repeat(np.arange(len(words)), sizes) * CLASSES + codes % CLASSES
    counts = np.bincount(at, minlength=len(words) * CLASSES).reshape(len(words), CLASSES)
    return np.concatenate([sizes[:, None] * _LENGTH, counts], axis=1).astype(np.int32)


class Tree:
    """A k-d tree: splits[i] is (dimension, value, left, right), with children below 0 for leaves (-1 - number). `members` are the leaves' points."""

    def __init__(self, points: np.ndarray, most: int) -> None:
        self.splits: list[tuple[int, int, int, int]] = []
        self.members: list[np.ndarray] = []
        self.root = self._grown(points, np.arange(len(points)), most)

    def _grown(self, points: np.ndarray, some: np.ndarray, most: int) -> int:
        if len(some) > most:
            here = points[some]
            spread = here.astype(np.float64).var(axis=0)
            d = 0 if spread[0] else int(spread.argmax())  # first lengths, which no edit of one kind crosses
            if spread[d]:
                values, counts = np.unique(here[:, d], return_counts=True)
                v = int(values[np.abs(np.cumsum(counts)[:-1] - len(some) / 2).argmin()])
                low = here[:, d] <= v
                place = len(self.splits)
                self.splits.append((0, 0, 0, 0))
                self.splits[place] = (d, v, self._grown(points, some[low], most), self._grown(points, some[~low], most))
                return place
        self.members.append(some)
        return -len(self.members)

    def reach(self, x: np.ndarray, more: int, less: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, rows of x, whether they lie in it) for the leaves whose box is at most `more` above and `less` below the row, over all coordinates."""
        far = 1 << 30
        todo = [(self.root, np.arange(len(x)), np.zeros(len(x), np.int32), np.zeros(len(x), np.int32), {})]
        while todo:
            node, rows, up, down, box = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -1 - node, rows, (up == 0) & (down == 0)
                continue
            d, v, left, right = self.splits[node]
            low, high = box.get(d, (-far, far))
            at = x[rows, d]
            below = down + np.maximum(at - v, 0) - np.maximum(at - high, 0)
            above = up + np.maximum(v + 1 - at, 0) - np.maximum(low - at, 0)
            a, b = below <= less, above <= more
            todo.append((left, rows[a], up[a], below[a], {**box, d: (low, v)}))
            todo.append((right, rows[b], above[b], down[b], {**box, d: (v + 1, high)}))


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For all rows of a and b, of one length: whether exactly one letter differs."""
    return (a[:, None, :] != b[None, :, :]).sum(axis=2, dtype=np.int32) == 1


def inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For all rows of a, and of b with one letter more: whether b is a with a letter inserted: equal from the front and from the back, together long enough."""
    front = a[:, None, :] == b[None, :, :-1]
    back = (a[:, None, :] == b[None, :, 1:])[:, :, ::-1]
    lead, trail = (np.where(x.all(axis=2), x.shape[2], x.argmin(axis=2)) for x in (front, back))
    return lead + trail >= a.shape[1]


class Shelf:
    """A cell's words of one length, in a tree."""

    def __init__(self, rows: list[int], words: list[str], x: np.ndarray) -> None:
        self.rows = np.array(rows)
        self.letters = letters_of([words[i] for i in rows], len(words[rows[0]]))
        x = x[self.rows]
        self.tree = Tree(x, LEAF_WORDS)
        self.boxes = [(x[m].min(axis=0), x[m].max(axis=0)) for m in self.tree.members]

    def near(self, x: np.ndarray, letters: np.ndarray, longer: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows asking, rows of the cell) that are one edit apart. longer: the shelf's words have one letter more than those that ask."""
        less, test = (0, inserted) if longer else (1, replaced)
        held, size = [], 0
        for leaf, asking, _ in self.tree.reach(x, 1, less):
            low, high = self.boxes[leaf]
            here = x[asking]
            asking = asking[(np.maximum(low - here, 0).sum(axis=1) <= 1) & (np.maximum(here - high, 0).sum(axis=1) <= less)]
            members = self.tree.members[leaf]
            # words with one vector cannot be split, so a leaf can be large
            wide = max(1, COMPARED // max(1, self.letters.shape[1]))
            for j in range(0, len(members), max(1, min(len(members), wide))):
                some = members[j: j + wide]
                step = max(1, wide // len(some))
                for i in range(0, len(asking), step):
                    a, b = np.nonzero(test(letters[asking[i: i + step]], self.letters[some]))
                    held.append((asking[i + a], self.rows[some[b]]))
                    size += len(a)
                    if size >= PAIRS_HELD:
                        yield tuple(map(np.concatenate, zip(*held)))
                        held, size = [], 0
        if size:
            yield tuple(map(np.concatenate, zip(*held)))


class Found:
    """Counts of near words, and the best of them, for a list of words."""

    def __init__(self, words: list[str], n: np.ndarray) -> None:
        self.words, self.n = words, n
        order = sorted(range(len(words)), key=words.__getitem__)
        by_word = np.empty(len(words), np.int64)
        by_word[order] = np.arange(len(words))
        self.rank = np.empty(len(words), np.int64)  # 0: largest n, ties: smallest word
        self.rank[np.lexsort((by_word, -n))] = np.arange(len(words))
        self.count = np.zeros(len(words), np.int64)
        self.best: dict[int, tuple[int, str]] = {}

    def add(self, mine: np.ndarray, theirs: np.ndarray, other: Found) -> None:
        self.count += np.bincount(mine, minlength=len(self.words))
        order = np.lexsort((other.rank[theirs], mine))
        mine, theirs = mine[order], theirs[order]
        first = np.concatenate([[True], mine[1:] != mine[:-1]])
        for i, j in zip(mine[first].tolist(), theirs[first].tolist()):
            new = (-int(other.n[j]), other.words[j])
            if i not in self.best or new < self.best[i]:
                self.best[i] = new

    def rows(self) -> pa.RecordBatch:
        at = np.flatnonzero(self.count).tolist()
        return pa.RecordBatch.from_arrays([pa.array([self.words[i] for i in at], pa.string()), pa.array(self.count[at], pa.int64()),
                                           pa.array([-self.best[i][0] for i in at], pa.int64()), pa.array([self.best[i][1] for i in at], pa.string())],
                                          names=["word", "n_near", "best_n", "best"])


class Cell:
    """The words of a cell."""

    def __init__(self, words: list[str], n: np.ndarray) -> None:
        self.found = Found(words, n)
        self.x = vectors(words)
        self.shelves = {size: Shelf(rows, words, self.x) for size, rows in by_length(words).items()}
        for size, shelf in self.shelves.items():
            for a, b in shelf.near(self.x[shelf.rows], shelf.letters, False):
                self.found.add(shelf.rows[a], b, self.found)

    def ask(self, words: list[str], n: np.ndarray, longer: bool) -> Found:
        """What words of other cells find here; the cell's own words learn of it as well."""
        found, x = Found(words, n), vectors(words)
        x[:, 0] += _LENGTH * longer
        for size, rows in by_length(words).items():
            shelf = self.shelves.get(size + longer)
            if shelf:
                at = np.array(rows)
                for a, b in shelf.near(x[at], letters_of([words[i] for i in rows], size), longer):
                    found.add(at[a], b, self.found)
                    self.found.add(b, at[a], found)
        return found


def by_length(words: list[str]) -> dict[int, list[int]]:
    rows: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        rows.setdefault(len(w), []).append(i)
    return rows


def _route(tree: Tree):
    """(word, n) to a row for the word's own cell and for each cell that it has to ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            x = vectors(words)
            own = np.zeros(len(words), np.int64)
            same = []
            for cell, rows, inside in tree.reach(x, 1, 1):
                own[rows[inside]] = cell
                same.append((cell, rows[~inside]))
            sent = [(OWN, own, np.arange(len(words)))] + [(SAME, np.full(len(r), c), r) for c, rows in same if len(r := rows[own[rows] < c])]
            x[:, 0] += _LENGTH
            sent += [(LONGER, np.full(len(rows), cell), rows) for cell, rows, _ in tree.reach(x, 1, 0)]
            at = np.concatenate([r for _, _, r in sent])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([c for _, c, _ in sent]).astype(np.int32)),
                                              pa.array(np.repeat(np.array([k for k, _, _ in sent], np.int32), [len(r) for _, _, r in sent])),
                                              batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], names=["cell", "kind", "word", "n"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[str], np.ndarray]]:
    """Sorted batches as stretches of one cell and kind: a cell's own words whole, those that ask by ASK_WORDS or so."""
    now, words, n = None, [], []
    for batch in batches:
        cells, kinds, counts = (batch.column(c).to_numpy() for c in ("cell", "kind", "n"))
        some = batch.column("word").to_pylist()
        cuts = [0, *(np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(some)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            key = (int(cells[i]), int(kinds[i]))
            if now is not None and (key != now or (now[1] != OWN and len(words) >= ASK_WORDS)):
                yield *now, words, np.concatenate(n)
                words, n = [], []
            now = key
            words += some[i:j]
            n.append(counts[i:j])
    if words:
        yield *now, words, np.concatenate(n)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, cell = None, None
    for number, kind, words, n in _runs(batches):
        if number != at:
            if cell:
                yield cell.found.rows()
            at, cell = number, None
        if kind == OWN:
            cell = Cell(words, n)
        elif cell:  # a cell without words answers nothing
            yield cell.ask(words, n, kind == LONGER).rows()
    if cell:
        yield cell.found.rows()


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n and best for the words (word, n; each once) that have a near word."""
    bounded_batches(words.sparkSession)
    total = words.count()
    part = min(1.0, SAMPLE / max(total, 1))
    sample = [r.word for r in words.where(F.expr(f"pmod(xxhash64(word), 1000000) < {int(part * 1_000_000)}")).select("word").collect()]
    tree = Tree(vectors(sample), max(1, int(max(CELL_WORDS, total / MAX_CELLS) * part)))
    cells = len(tree.members)
    tree.members = []
    routed = words.select("word", "n").mapInArrow(_route(tree), _ROUTED)
    return (routed.repartition(cells, "cell").sortWithinPartitions("cell", "kind").mapInArrow(_search, _NEAR)
            .groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b"))
            .select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """word and root for a table of word and form."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = saved(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        now = step.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n for a table of distinct words and their counts n."""
    words = saved(words.where("word <> ''").select("word", F.col("n").cast("long").alias("n")), "words")
    found = saved(words.join(near_words(words), "word", "left").withColumn("has", F.col("best_n") >= ratio * F.col("n")), "near-words")
    forms = roots(found.where("has").select("word", F.col("best").alias("form")))
    return found.join(forms, "word", "left").select("word", F.when(F.col("has"), F.col("best")).alias("form"), F.coalesce("root", "word").alias("root"), "n",
                                                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("best_n")).alias("form_n"))
