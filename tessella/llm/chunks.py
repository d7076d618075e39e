"""Byte-level BPE of whole Arrow columns, by remembered chunks.

The split pattern of the public byte-level vocabularies never lets a match run from a
non-whitespace character into whitespace, and lets at most one leading space join a match.  So a
text falls into chunks, each either whitespace or an optional space and a run of other characters,
that encode independently of each other.

Frequent chunks are encoded once per worker; what was asked for lately is remembered.  Texts are cut together by
Arrow, and only their distinct words are looked up.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode White_Space (fixed values), as the split pattern's \s has it.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: White space that is odd anywhere, and what else of spaces and line feeds is odd between words.
_ODD_ASCII = ["\t", "\v", "\f", "\r"]
_ODD_OTHER = [c for c in map(chr, range(0x80, 0x3001)) if re.match(f"[{_WS}]", c)]
_DOUBLED = ["  ", "\n\n", " \n", "\n "]
#: Marks that never join letters.
_MARKS = frozenset(".,;:!?")
#: Longer chunks are not remembered.
LONG = 64
#: Bytes of texts that are encoded together: bounds a worker's memory.
STEP = 1 << 21


def odd(text: str) -> bool:
    """Whether a text has white space other than single spaces and line feeds between words.

    A dozen plain searches take a tenth of the time of one regular expression.
    """
    if text[0] in " \n" or text[-1] in " \n":
        return True
    return any(map(text.__contains__, _DOUBLED)) or any(map(text.__contains__, _ODD_ASCII)) or not text.isascii() and any(map(text.__contains__, _ODD_OTHER))


def pieces(chunk: str, split: Callable[[str], list[str]]) -> list[str]:
    """A chunk's pieces by ``split``, which words and words with a mark after them don't need."""
    word = chunk.removeprefix(" ")
    if word.isalpha():
        return [chunk]
    if word[-1:] in _MARKS and word[:-1].isalpha():
        return [chunk[:-1], chunk[-1]]
    return split(chunk)


class Recent(dict):
    """key -> value, made by ``make(key)`` at first sight; at most about ``most`` entries are remembered.

    When half as many are new, the older ones go that were not asked for since the last time.
    """

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.old = make, max(1, most // 2), {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONG:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value

    def seen(self, key: str) -> bytes | None:
        """The value if it is remembered."""
        return self.get(key) or self.old.get(key)


class TextEncoder:
    """Ids of texts (little-endian unsigned 32-bit integers in bytes).

    ``cut(chunk)`` gives a chunk's pieces and ``make(piece)`` a piece's ids; ``most`` bounds what is remembered of
    words after a space, and of pieces.
    """

    def __init__(self, make: Callable[[str], bytes], cut: Callable[[str], list[str]], most: int):
        self.cut, self.make, self.pieces = cut, make, Recent(make, most // 2)
        self.bare, self.spaced = Recent(self._chunk, most // 8), Recent(self._joined, most)
        self.newline = self._chunk("\n")

    def _joined(self, word: str) -> bytes:
        """A word with the space before it; one that begins with a line feed has that instead."""
        return self.newline + self.bare[word[1:]] if word[0] == "\n" else self._chunk(" " + word)

    def _chunk(self, chunk: str) -> bytes:
        found = self.cut(chunk)
        return self.make(chunk) if len(found) == 1 else b"".join(map(self.pieces.__getitem__, found))

    def text(self, text: str | None) -> bytes:
        """Ids of one text."""
        text = text or ""
        if not text or odd(text):
            return b"".join(map(self.bare.__getitem__, _CHUNK.findall(text)))
        out = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(self.bare[first])
            out.extend(map(self.spaced.__getitem__, rest))
            out.append(self.newline)
        out.pop()
        return b"".join(out)

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text."""
        out, plain, size = [b""] * len(texts), [], 0
        for k, text in enumerate(texts):
            if not text or len(text) > STEP or odd(text):
                out[k] = self.text(text)
                continue
            plain.append(k)
            size += len(text)
            if size >= STEP:
                self._plain(texts, plain, out)
                plain, size = [], 0
        if plain:
            self._plain(texts, plain, out)
        return out

    def _plain(self, texts: list[str | None], at: list[int], out: list[bytes]) -> None:
        """Puts the ids of ``texts``, none of them odd, into ``out``, both at the places ``at``."""
        try:
            column = pa.array([f"\n{texts[k]}" for k in at])
        except UnicodeEncodeError:  # lone surrogates
            for k in at:
                out[k] = self.text(texts[k])
            return
        # each line begins a word, the first one too; its line feed's ids are left out below
        lists = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
        words = lists.flatten().dictionary_encode()
        # the first word is the empty one before each text's first line
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = pa.array([b"", *map(self.spaced.__getitem__, distinct[1:])], pa.binary())
        ids = known.take(words.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[lists.offsets.to_numpy()].tolist()
        data, skip = memoryview(ids.buffers()[2]), len(self.newline)
        for k, a, b in zip(at, ends, ends[1:]):
            out[k] = bytes(data[a + skip : b])


def steps(batch: pa.RecordBatch, text: int, most: int = STEP) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of about ``most`` bytes in its column ``text``."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64)) // most
    bounds = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(bounds, bounds[1:]):
        if a < b:
            yield batch.slice(a, b - a)
