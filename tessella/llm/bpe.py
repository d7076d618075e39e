"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

Encoding.  A token sequence is the BPE encoding of its bytes exactly when every adjacent pair of
tokens is (checked by the merge rule on the pair alone, memoised).  Reading bytes left to right,
every prefix of a piece therefore has one encoding, and the token that ends it starts at one of the
few *live* positions: those from which the bytes read so far are the beginning of some token.  A
state of the determinised transducer is the set of live positions, each with the token that ends
there; a transition yields the token that ends at the new byte.  Tokens before the last position
that the encodings at all live positions share are settled and are emitted, so the lookahead is
bounded by the longest token.  States and transitions are made when input first needs them and are
shared afterwards; the table starts anew when it is full.

Decoding.  A table gives, for each UTF-8 automaton state and token, the state after the token, so a
stream of ids is decoded in parts that may split characters anywhere.

Defined results: null and empty texts have no tokens; special tokens are ordinary text; very long texts, and
pieces of any length, are encoded whole; each row has a row of the result, repeated ones and those with a null
doc_id too; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import TextEncoder, pieces, steps

#: What a worker remembers: transducer states (and four times as many token pairs), words, and half as many pieces.
MAX_STATES, MAX_CHUNKS = 250_000, 800_000
#: The same where executors are short of memory: slower, some 200 MB a worker less.
FEW_STATES, FEW_CHUNKS = 60_000, 150_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _State(dict):
    """byte -> next state; filled in when first asked."""

    __slots__ = ("live", "machine", "last")

    def __init__(self, live, machine):
        super().__init__()
        self.live, self.machine = live, machine
        self.last = live[-1][1]  # the token that ends here

    def __missing__(self, byte):
        step = self[byte] = self.machine.step(self.live, byte)
        return step


class MergeTransducer:
    """ids of one piece of text, equal to merging by rank."""

    #: Bytes between two looks for settled tokens.
    LOOK = 256

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.tokens = {i: t for t, i in ranks.items()}
        self.width = {i: len(t) for t, i in ranks.items()}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte must be a token")
        # a trie over the tokens, node 0 its root: (node << 8 | byte) -> node, and by node the depth, the token, any children
        self.below: dict[int, int] = {}
        self.depth, self.ends_token, self.goes_on = [0], [-1], [True]
        for token, i in ranks.items():
            node = 0
            for byte in token:
                self.goes_on[node] = True
                child = self.below.get(node << 8 | byte)
                if child is None:
                    child = self.below[node << 8 | byte] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                    self.ends_token.append(-1)
                    self.goes_on.append(False)
                node = child
            self.ends_token[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.states: dict[tuple, _State] = {}
        self.start = self._state(((0, -1),))

    def _state(self, live) -> _State:
        found = self.states.get(live)
        if found is None:
            if len(self.states) >= self.max_states:
                self.states.clear()
                self.start = self.states[((0, -1),)] = _State(((0, -1),), self)
            found = self.states[live] = _State(live, self)
        return found

    def _merge(self, piece: bytes) -> list[int]:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= 4 * self.max_states:
                self.pairs.clear()
            known = self._merge(self.tokens[left] + self.tokens[right]) == [left, right]
            self.pairs[left, right] = known
        return known

    def step(self, live, byte: int) -> _State:
        """The state after ``byte``. ``live``: (trie node of the bytes since the position, the token that ends there)."""
        below, ends, after = self.below, -1, []
        for node, left in live:
            node = below.get(node << 8 | byte)
            if node is not None:
                if ends < 0 and (t := self.ends_token[node]) >= 0 and (left < 0 or self.fits(left, t)):
                    ends = t
                if self.goes_on[node]:
                    after.append((node, left))
        if ends < 0:
            raise ValueError("the vocabulary is not closed under its merges")
        after.append((0, ends))
        return self._state(tuple(after))

    def _settled(self, ends: list[int], live) -> int:
        """The last position that the encodings at all live positions go through."""
        at = {len(ends) - self.depth[node] for node, _ in live}
        while len(at) > 1:
            far = max(at)
            at.remove(far)
            at.add(far - self.width[ends[far - 1]])
        return at.pop()

    def _back(self, ends: list[int], at: int) -> list[int]:
        out = []
        while at:
            out.append(ends[at - 1])
            at -= self.width[ends[at - 1]]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        state, out, ends = self.start, [], []  # ends: the token that ends at each byte not yet settled
        for at in range(0, len(piece), self.LOOK):
            for byte in piece[at : at + self.LOOK]:
                state = state[byte]
                ends.append(state.last)
            if at + self.LOOK < len(piece):
                settled = self._settled(ends, state.live)
                out += self._back(ends, settled)
                del ends[:settled]
        return out + self._back(ends, len(ends))


class Utf8Machine:
    """The states of a UTF-8 reader: 0 between characters, 1-7 inside one, 8 after an error."""

    ERROR = 8
    #: state -> (lowest and highest byte that may follow, state then): the well-formed sequences (fixed values)
    INSIDE = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}
    LEAD = ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7))

    def __init__(self):
        self.table = np.full((9, 256), self.ERROR, np.uint8)
        for low, high, to in self.LEAD:
            self.table[0, low : high + 1] = to
        for state, (low, high, to) in self.INSIDE.items():
            self.table[state, low : high + 1] = to

    def over(self, tokens: list[bytes]) -> np.ndarray:
        """[state, token] -> state after the token's bytes."""
        width = max(map(len, tokens))
        at = np.repeat(np.arange(9, dtype=np.uint8)[:, None], len(tokens), axis=1)
        lengths = np.array([len(t) for t in tokens])
        flat = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in tokens), np.uint8).reshape(len(tokens), width)
        for k in range(width):
            on = lengths > k
            at[:, on] = self.table[at[:, on], flat[on, k]]
        return at


class StreamDecoder:
    """Turns ids, fed in parts of any size, into UTF-8 text; a character is given out when it is complete."""

    def __init__(self, codec: "ByteBpe"):
        self.codec, self.state, self.held = codec, 0, b""

    def feed(self, ids: np.ndarray) -> bytes:
        after, numbers, state, n = self.codec.rows_after, ids.tolist(), self.state, len(ids)
        at = open_from = 0
        # tokens that leave the reader between characters need no look one by one
        odd = iter([] if not n else np.flatnonzero(self.codec.after[0, ids]).tolist())
        while True:
            while state and at < n:
                state = after[state][numbers[at]]
                at += 1
            if state == Utf8Machine.ERROR:
                raise ValueError("these ids are not UTF-8")
            if state or (start := next((k for k in odd if k >= at), None)) is None:
                break
            open_from, state, at = start, after[0][numbers[start]], start + 1
        whole = open_from if state else n  # ids before ``whole`` end at a character's end
        data = list(map(self.codec.tokens.__getitem__, numbers))
        self.state = state
        if not whole:
            self.held += b"".join(data)
            return b""
        out, self.held = self.held + b"".join(data[:whole]), b"".join(data[whole:])
        return out

    def close(self) -> None:
        if self.state:
            raise ValueError("the text ends inside a character")


class ByteBpe:
    """A rank file's vocabulary with the pattern that splits text before the merges."""

    def __init__(self, path: str, pattern: str, states: int = MAX_STATES, chunks: int = MAX_CHUNKS):
        self.machine = MergeTransducer(read_ranks(path), states)
        self.split = regex.compile(pattern)
        ids = self.machine.tokens
        self.tokens = [ids.get(i, b"") for i in range(max(ids) + 1)]
        self.after = Utf8Machine().over(self.tokens)
        self.rows_after = self.after.tolist()
        self.encoder = TextEncoder(self._piece, lambda chunk: pieces(chunk, self.split.findall), chunks)

    def _piece(self, piece: str) -> bytes:
        ids = self.machine.encode(piece.encode("utf-8", "replace"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encoder.text(text), "<u4")

    def texts(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        return [np.frombuffer(x, "<u4") for x in self.encoder.texts(column.to_pylist())]

    def decode(self, ids: np.ndarray, part: int = 1 << 16) -> bytes:
        """The UTF-8 bytes of a text's ids."""
        stream = StreamDecoder(self)
        out = [stream.feed(ids[at : at + part]) for at in range(0, len(ids), part)]
        stream.close()
        return b"".join(out)


@lru_cache(maxsize=1)
def codec(path: str, pattern: str, states: int = MAX_STATES, chunks: int = MAX_CHUNKS) -> ByteBpe:
    """One codec a worker."""
    return ByteBpe(path, pattern, states, chunks)


def forget() -> None:
    """Frees a worker's codec."""
    codec.cache_clear()
    gc.collect()  # its parts refer to each other


def _per_text(docs: DataFrame, schema: str, names: list[str], rows, done=None) -> DataFrame:
    """``rows`` of each text; ``done`` is called when a task ends."""

    def run(batches):
        for batch in batches:
            for part in steps(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), *rows(part.column(1))], names)
        if done:
            done()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers in one binary)."""

    def rows(texts):
        bpe = codec(path, pattern)
        return [pa.array([ids.tobytes() for ids in bpe.texts(texts)], pa.binary())]

    return _per_text(docs, "doc_id long, ids binary", ["doc_id", "ids"], rows)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text of ``encode``'s rows."""

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            texts = [bpe.decode(np.frombuffer(x.as_py() or b"", "<u4")).decode() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, states: int = MAX_STATES, chunks: int = MAX_CHUNKS, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: texts are encoded and their ids decoded in one pass.

    ``states`` and ``chunks`` bound what a worker remembers; unless it is to ``keep`` its codec, that ends with a
    task.  Results don't depend on them.
    """

    def rows(texts):
        bpe, n, of_ids, of_text = codec(path, pattern, states, chunks), [], [], []
        for ids in bpe.texts(texts):
            n.append(len(ids))
            of_ids.append(hashlib.sha256(ids.tobytes()).hexdigest())
            of_text.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)]

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return _per_text(docs, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", names, rows, None if keep else forget)
