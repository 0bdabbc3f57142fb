"""Ids of a public tokenizer's vocabulary for whole texts, with a memory of the pieces of text met before."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers.pre_tokenizers import ByteLevel

from headrisk.llm.common import Memory, parts_of

#: Pieces that a worker remembers for certain; at most twice as many.
REMEMBERED = 500_000
#: Text that is cut into pieces at once, in characters; a longer text is cut by itself.
CHARS_AT_ONCE = 4 << 20
#: New pieces that go to the tokenizer as one text.
JOINED = 10_000
#: A piece is a run of spaces and newlines with what follows up to the next one; byte-level pre-tokens never cross from a
#: character that is no white space to one that is, so the pieces' ids joined are the text's. That holds where spaces and
#: newlines are the only white space; other texts go to the tokenizer whole.
_OTHER_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85᠎​﻿]")
_OTHER_ASCII = bytes(b for b in range(128) if _OTHER_SPACE.match(chr(b)))
#: Marks after a letter are a pre-token of their own, so a piece ends there as well.
_MARKS = b".,;:!?#*$%&|"
_SPACES = b" \n"
DTYPE = "<u4"


def _members(of: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[np.frombuffer(of, np.uint8)] = True
    return found


_IS_SPACE, _IS_MARK = _members(_SPACES), _members(_MARKS)
_IS_LETTER = _members(bytes(b for b in range(128) if chr(b).isalpha()))
#: The second byte of the letters U+00C0 to U+00FF, after 0xC3; the other two characters there are signs.
_IS_SECOND = _members(bytes(b for b in range(0x80, 0xC0) if chr(b + 0x40).isalpha()))


def piece_starts(data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where pieces start in the UTF-8 bytes of texts one after the other."""
    space = _IS_SPACE[data]
    starts = np.zeros(len(data), bool)
    starts[text_starts[text_starts < len(data)]] = True
    starts[1:] |= space[1:] & ~space[:-1]
    letter = _IS_LETTER[data]
    letter[1:] |= _IS_SECOND[data[1:]] & (data[:-1] == 0xC3)
    starts[1:] |= _IS_MARK[data[1:]] & letter[:-1]
    return np.flatnonzero(starts)


def _has_other_space(text: str) -> bool:
    if text.isascii():  # a table of bytes tells it faster
        return len(text.encode().translate(None, _OTHER_ASCII)) < len(text)
    return bool(_OTHER_SPACE.search(text))


def ids_of_pieces(data: np.ndarray, text_starts: np.ndarray, starts: np.ndarray, memory: Memory, learn: Callable[[list[bytes]], None]) -> list[bytes]:
    """The ids of each text (little-endian unsigned 32-bit) from those of its pieces. Each distinct piece is looked up once; `learn` puts new ones into the memory."""
    borders = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, borders, pa.py_buffer(data)]).dictionary_encode()
    distinct, index = pieces.dictionary.to_pylist(), pieces.indices.to_numpy()
    learn(list(memory.missing(set(distinct))))
    found = [memory.now[p] for p in distinct]
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    ids, of = np.frombuffer(b"".join(found), DTYPE), np.cumsum(sizes) - sizes
    counts = sizes[index]
    ends = np.cumsum(counts)
    flat = ids[np.repeat(of[index] - (ends - counts), counts) + np.arange(counts.sum())].tobytes()
    upto = np.append(0, ends)[np.searchsorted(starts, text_starts)].tolist()  # an empty text starts no piece
    return [flat[4 * a:4 * b] for a, b in zip(upto, upto[1:])]


class Encoder:
    """Gives texts their ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, remember: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: A text with an added token's string goes to the tokenizer whole: the string is that token there, wherever pieces would end.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of each entry, which byte-level vocabularies write with a character for each byte.
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.sizes[list(vocabulary.values())] = [len(x) for x in vocabulary]
        if not set(ByteLevel.alphabet()) <= vocabulary.keys():
            raise ValueError("the vocabulary is not one of bytes")
        self.known = Memory(remember)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, DTYPE) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        """Puts the ids of new pieces into the memory. Pieces that start with white space and go on after it can be joined to one text:
        a piece ends where the next one starts, and the sizes of the entries tell which ids are whose."""
        known = self.known.now
        alone = [p for p in new if p[0] not in _SPACES or not p.strip(_SPACES)]
        known.update(zip(alone, (x.tobytes() for x in self._whole([p.decode() for p in alone]))))
        joinable = list(set(new).difference(alone))
        for i in range(0, len(joinable), JOINED):
            some = joinable[i:i + JOINED]
            ids = self._whole([b"".join(some).decode()])[0]
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(p) for p in some])) + 1
            data = ids.tobytes()
            known.update((p, data[4 * a:4 * b]) for p, a, b in zip(some, [0, *ends.tolist()], ends.tolist()))

    def _pieced(self, texts: list[str]) -> list[bytes]:
        coded = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(coded), np.uint8)
        text_starts = np.cumsum([0, *map(len, coded)])
        return ids_of_pieces(data, text_starts, piece_starts(data, text_starts[:-1]), self.known, self._learn)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Meant for many texts at a time, whose new pieces are encoded together; the memory for it is bounded by `CHARS_AT_ONCE` or the longest text."""
        out: list[bytes] = []
        for some in parts_of([t or "" for t in texts], CHARS_AT_ONCE):
            apart = [_has_other_space(t) or any(a in t for a in self.added) for t in some]
            whole = iter([self._whole([t])[0].tobytes() for t, a in zip(some, apart) if a])
            pieced = iter(self._pieced([t for t, a in zip(some, apart) if not a]))
            out.extend(next(whole) if a else next(pieced) for a in apart)
        return out


@lru_cache(2)
def encoder(path: str, remember: int = REMEMBERED) -> Encoder:
    """The encoder of a worker, kept between its tasks. Fewer remembered pieces take less memory and more time."""
    return Encoder(path, remember)
