"""SentencePiece encoding and decoding with a weighted finite-state transducer.

Compiled from a model file: the normaliser (a space becomes the word mark, one mark goes in front), a trie of the pieces, byte fallback for characters
without a piece, and weights. Composed with a text, that gives a lattice whose states are a place and the piece that
ends there; the tropical-semiring shortest path through it (weights add up along a path, the least wins) is the encoding.

The model merges pairs by rank (BPE), and sums of ranks do not reproduce such merges. What does is a weight for neighbours: two pieces may follow one another
only if merging their joined text from characters gives just these two again; every other pair has infinite weight, as has a piece that is not
what its own text merges to. A sequence of which all neighbours are good in that sense is the one that merging gives, so the path of finite weight, one for each piece, is the
model's own encoding. The tests compare it with the library's.

No piece has a word mark after another character, and many pairs of characters stand side by side in no piece at all, so texts are composed in parts that end there, and a
worker remembers the paths of parts it has met. As each prefix of a part has one path of finite weight at most, the first one that a search by depth finds is the shortest.

Nulls: a null text is empty and has no ids. Texts of any length are read whole: the lattice is as long as the longest part. Decoding inverts encoding for every
text; byte pieces that are no UTF-8 become U+FFFD. Repeated rows get equal ids; an empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from headrisk.llm.common import Memory, bounded_batches, parts_of
from headrisk.llm.tokens import CHARS_AT_ONCE, DTYPE, ids_of_pieces

MARK = "▁"
_MARK_BYTES = MARK.encode()
#: Parts that a worker remembers for certain; at most twice as many. Pairs of pieces likewise.
REMEMBERED = 500_000
REMEMBERED_PAIRS = 1_000_000
_PROBE = "  a b\tC é ﬁ\n"


class Transducer:
    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(_PROBE) != self.normalize(_PROBE):
            raise ValueError("the model's normaliser is not of the kind compiled here")
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes, self.rank, self.hidden = {}, {}, set()
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.bytes[i] = int(piece[3:5], 16)
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.hidden.add(i)
            else:
                self.rank[piece] = (-model.get_score(i), i)
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.rank):
            raise ValueError("a piece has a word mark after another character")
        self.byte_id = {b: i for i, b in self.bytes.items()}
        self.trie: dict = {}
        for piece, (_, i) in self.rank.items():
            if self.merged(piece) == [piece]:
                node = self.trie
                for c in piece:
                    node = node.setdefault(c, {})
                node[""] = i
        #: Whether two ASCII characters stand side by side in a piece; other bytes count as if they did.
        self.side_by_side = np.ones((256, 256), bool)
        self.side_by_side[:128, :128] = False
        for piece in self.rank:
            coded = np.frombuffer(piece.encode(), np.uint8)
            self.side_by_side[coded[:-1], coded[1:]] = True
        self.written = [b"" if i in self.hidden else bytes([self.bytes[i]]) if i in self.bytes else p.encode() for i, p in enumerate(self.pieces)]
        self.good: dict[int, bool] = {}
        self.known = Memory(REMEMBERED)

    @staticmethod
    def normalize(text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text: always the pair with the best rank, the first of them."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank[a + b][0], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _may_follow(self, key: int) -> bool:
        """Whether a pair, as first * number of pieces + second, has finite weight; the answers are the compiled part of the weights."""
        x, y = (self.pieces[i] for i in divmod(key, len(self.pieces)))
        if len(self.good) >= REMEMBERED_PAIRS:
            self.good.clear()
        good = self.good[key] = self.merged(x + y) == [x, y]
        return good

    def _arcs(self, word: str, at: int) -> list[tuple[int, int]]:
        """End and piece of each arc from a place, the longest last; a character that is no piece has its byte fallback, as a negative number."""
        node, j, length, arcs = self.trie, at, len(word), []
        while j < length and (node := node.get(word[j])) is not None:
            j += 1
            if (piece := node.get("")) is not None:
                arcs.append((j, piece))
        if not arcs or arcs[0][0] != at + 1:
            arcs.insert(0, (at + 1, -ord(word[at]) - 1))
        return arcs

    def path(self, word: str) -> list[int]:
        """The shortest path, by depth with the longest arcs first. A state, a place with the piece that ends there, is left for good if it leads nowhere,
        so each is met once."""
        size, length, good = len(self.pieces), len(word), self.good
        out: list[int] = []
        met: set[tuple[int, int]] = set()
        rest = [self._arcs(word, 0)]
        while True:
            arcs = rest[-1]
            if not arcs:
                rest.pop()
                out.pop()
                continue
            end, piece = arcs.pop()
            if out and piece >= 0 and (last := out[-1]) >= 0:
                key = last * size + piece
                fits = good.get(key)
                if not (self._may_follow(key) if fits is None else fits):
                    continue
            if (end, piece) in met:
                continue
            met.add((end, piece))
            out.append(piece)
            if end == length:
                return out
            rest.append(self._arcs(word, end))

    def _learn(self, new: list[bytes]) -> None:
        for w in new:
            ids: list[int] = []
            for p in self.path(w.decode()):
                ids.extend([p] if p >= 0 else [self.byte_id[b] for b in chr(-p - 1).encode()])
            self.known.now[w] = np.array(ids, DTYPE).tobytes()

    def _part_starts(self, data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
        """Where parts start in the UTF-8 bytes of normalised texts: at the first of some marks, and between characters that no piece holds side by side."""
        starts = np.zeros(len(data), bool)
        starts[text_starts[text_starts < len(data)]] = True
        starts[1:] |= ~self.side_by_side[data[:-1], data[1:]]
        if len(data) > 2:
            mark = np.zeros(len(data), bool)
            mark[:-2] = (data[:-2] == _MARK_BYTES[0]) & (data[1:-1] == _MARK_BYTES[1]) & (data[2:] == _MARK_BYTES[2])
            starts[3:] |= mark[3:] & ~mark[:-3]
        return np.flatnonzero(starts)

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return self.encode([text])[0]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, whose parts are looked up together."""
        out: list[bytes] = []
        for some in parts_of([self.normalize(t or "") for t in texts], CHARS_AT_ONCE):
            coded = [t.encode() for t in some]
            data = np.frombuffer(b"".join(coded), np.uint8)
            text_starts = np.cumsum([0, *map(len, coded)])
            out.extend(ids_of_pieces(data, text_starts, self._part_starts(data, text_starts[:-1]), self.known, self._learn))
        return out

    def text(self, ids: bytes) -> str:
        joined = b"".join(map(self.written.__getitem__, np.frombuffer(ids, DTYPE).tolist())).decode(errors="replace")
        return joined.removeprefix(MARK).replace(MARK, " ")


@lru_cache(2)
def transducer(path: str) -> Transducer:
    """The compiled model of a worker, kept between its tasks."""
    return Transducer(path)


def encoded(model: str, text: str = "text") -> F.Column:
    """The ids of a text column as binary, little-endian unsigned 32-bit."""
    @F.arrow_udf(T.BinaryType())
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(transducer(model).encode(texts.to_pylist()), pa.binary())

    return of(text)


def decoded(model: str, ids: str = "ids") -> F.Column:
    """The text of a column of such ids; null for null."""
    @F.arrow_udf(T.StringType())
    def of(column: pa.Array) -> pa.Array:
        return pa.array([transducer(model).text(x.as_py()) if x.is_valid else None for x in column], pa.string())

    return of(ids)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """The documents with `ids`."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn("ids", encoded(model))


def decode(rows: DataFrame, model: str) -> DataFrame:
    """The rows with `text` made from `ids`."""
    return rows.withColumn("text", decoded(model))
