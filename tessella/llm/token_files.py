"""Token ids in files: frequency-ranked ids in byte-aligned variable-length coding.

File format (Parquet as the container, uncompressed).  ``ranks/``: one row, the ids by falling corpus
frequency, little-endian unsigned 32-bit integers.  ``ids/``: one row for each run of documents, with
``start`` (ids of all documents before it), ``doc_ids``, ``counts`` (ids of each document), ``n`` (their sum),
and two binaries.  ``control`` has two bits for each id, four ids a byte from the low bits up: the bytes of its
rank less one.  ``data`` has the ranks' bytes, lowest first, without gaps.  Ranks below 256 take one byte, so
frequent ids are short.  Reading looks a control byte up in tables of its four lengths and needs no branch an id.

Documents lie in ascending order of doc_id: part files are ranges of doc_id in the order of their names, and
rows ascend in a file.

Defined results: null and empty texts consist of the end id alone; very long texts are runs of their own; a
null doc_id comes before all others; documents that share a doc_id lie side by side, in an order that their
ids settle, so that repeated rows change nothing; a doc_id with a large part of all rows is dealt to as many part
files as it fills; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import struct
import zlib
from codecs import charmap_decode
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .chunks import _MARKS, TextEncoder, pieces, steps
from .shared import cut, shared_path

END = 2
#: Documents in a part file, about, and ids in a run, at least (but for a file's last).
BUCKET, RUN = 8_192, 1 << 18
#: Part files become larger beyond this many.
MOST_BUCKETS = 32_768
#: Words that a worker remembers, about, and half as many pieces.
CACHE = 700_000
#: The last letter of which Python's classes and the library's are the same.
LATIN = "\u024f"
_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]
#: Stands for a null doc_id where rows are ordered.
FIRST = -(1 << 63)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones as they are, others from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder(TextEncoder):
    """Ids of whole texts by the ``tokenizers`` library; special tokens are ordinary text.

    Chunks (see ``chunks``) are split by the vocabulary's pattern, and the library's model encodes each
    piece.  A tokenizer with any other processing is refused.
    """

    def __init__(self, path: str):
        with open(path) as f:
            made = json.load(f)
        splits = made["pre_tokenizer"]
        if splits["type"] != "ByteLevel" or splits["add_prefix_space"] or not splits.get("use_regex", True) or made["normalizer"]:
            raise ValueError("only a plain byte-level tokenizer can be encoded chunk by chunk")
        tokenizer = Tokenizer.from_file(path)
        self.model, self.splitter = tokenizer.model, tokenizer.pre_tokenizer
        self.letters = "".join(letter for _, letter in sorted(_byte_letters().items()))
        self.pattern = regex.compile(public_tokenizers.PATTERN).findall
        self.space = self.letters[32]
        self.size = 1 + max(tokenizer.get_vocab(with_added_tokens=False).values())
        super().__init__(self._ids, self._cut, CACHE)

    def _chunk(self, chunk: str) -> bytes:
        """As the base class has it; a word of Latin letters, perhaps with a mark after it, needs no general path."""
        word = chunk[1:] if chunk[0] == " " else chunk
        if word.isalpha():
            if chunk.isascii() or max(word) <= LATIN:
                return self._letters_only(chunk)
        elif word[-1:] in _MARKS and word[:-1].isalpha() and (chunk.isascii() or max(word) <= LATIN):
            known = self.spaced.seen(word[:-1]) if word is not chunk else None
            return (known or self._letters_only(chunk[:-1])) + self.pieces[chunk[-1]]
        return super()._chunk(chunk)

    def _letters_only(self, piece: str) -> bytes:
        if piece.isascii():
            found = self.model.tokenize(self.space + piece[1:] if piece[0] == " " else piece)
        else:
            found = self.model.tokenize(self._spelt(piece))
        ids = [t.id for t in found]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def _spelt(self, piece: str) -> str:
        """The letters of a piece's bytes."""
        return charmap_decode(piece.encode("utf-8", "replace"), "strict", self.letters)[0]

    def _cut(self, chunk: str) -> list[str]:
        if not chunk.isascii() and max(chunk) > LATIN:  # beyond Latin, letters depend on the library's own tables
            return [chunk[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(chunk)]
        return pieces(chunk, self.pattern)

    def _ids(self, piece: str) -> bytes:
        if piece.isascii() and piece[piece[0] == " " :].isalpha():
            return self._letters_only(piece)
        ids = [t.id for t in self.model.tokenize(self._spelt(piece))]
        return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a worker."""
    return Encoder(path)


def _encoded(docs: DataFrame, path: str, end: int, bounds: list[int], width: int) -> DataFrame:
    """doc_id, bucket, n (its ids), ids (``width`` bytes each, compressed, as they are shuffled and kept).

    A bucket is the number of bounds that are not above doc_id.  Where several bounds are equal that doc_id has
    a large part of all rows, and its rows are dealt to the buckets around them by a hash of their ids.
    """
    limits = np.array(bounds, np.int64)
    names = ["doc_id", "bucket", "n", "ids"]

    def run(batches):
        encode, last = encoder(path).texts, np.array([end], "<u4").tobytes()
        for batch in batches:
            for part in steps(batch, 1):
                raw = [np.frombuffer(x + last, "<u4").astype(f"<u{width}").tobytes() for x in encode(part.column(1).to_pylist())]
                key = part.column(0).fill_null(FIRST).to_numpy()
                low, high = np.searchsorted(limits, key, "left"), np.searchsorted(limits, key, "right")
                bucket = high.astype(np.int32)
                for k in np.flatnonzero(high - low > 1).tolist():
                    bucket[k] = low[k] + zlib.crc32(raw[k]) % (high[k] - low[k] + 1)
                n = pa.array([len(x) // width for x in raw], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bucket), n, pa.array([pa.compress(x, codec="lz4", asbytes=True) for x in raw], pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, bucket int, n long, ids binary")


def compress(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ``ranks``."""
    ranks = ranks.astype("<u4")
    codes, used = np.zeros(-(-len(ranks) // 4) * 4, np.uint8), np.ones((len(ranks), 4), bool)
    for k in (1, 2, 3):
        used[:, k] = ranks >> np.uint32(8 * k) != 0
        codes[: len(ranks)] += used[:, k]
    control = codes[::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


#: Lengths of the four values of every control byte.
_LENGTHS = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8)


def expand(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of ``compress``."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    start = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data, np.uint8)
    ranks = raw[start].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        at = np.flatnonzero(size > k)
        ranks[at] |= raw[start[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def _bounds(docs: DataFrame, bucket: int) -> list[int]:
    """The doc_ids that part the rows into buckets of about ``bucket``, from that column alone."""
    n = docs.count()
    parts = max(1, min(MOST_BUCKETS, -(-n // bucket)))
    if parts == 1:
        return []
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).cast("double")
    found = docs.select(place.alias("d")).approxQuantile("d", [k / parts for k in range(1, parts)], 0.1 / parts)
    return sorted(max(FIRST, min(-FIRST - 1, int(b))) for b in found)


def _nulls_first(doc_id: str = "doc_id") -> Column:
    return F.asc_nulls_first(doc_id)


def write(docs: DataFrame, tokenizer: str, path: str, end: int = END, bucket: int = BUCKET) -> None:
    """Encodes ``docs`` and writes the files under ``path``."""
    spark = docs.sparkSession
    bounds = _bounds(docs, bucket)
    width = 2 if max(end, encoder(tokenizer).size - 1) < 1 << 16 else 4  # these bytes travel
    kind = np.dtype(f"<u{width}")
    dealt = _encoded(docs, tokenizer, end, bounds, width).repartitionById(len(bounds) + 1, "bucket")
    by_id = cut(dealt.sortWithinPartitions(_nulls_first(), "ids"))

    def plain(ids: bytes, n: int) -> bytes:
        return pa.decompress(ids, n * width, codec="lz4", asbytes=True)

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            raw = b"".join(map(plain, batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            seen = np.bincount(np.frombuffer(raw, kind), minlength=len(total))
            seen[: len(total)] += total
            total = seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    counted = by_id.select("ids", "n").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = np.array([r["id"] for r in counted.orderBy(F.desc("n"), "id").collect()], "<u4")  # bounded by the vocabulary
    rank_of = np.zeros(int(ranked.max(initial=0)) + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    sizes = by_id.groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row a part file: bounded
    before = np.zeros(len(bounds) + 2, np.int64)
    for r in sizes:
        before[r["bucket"] + 1] = r["n"]
    given = spark.sparkContext.broadcast((rank_of, np.cumsum(before)))

    def runs(batches):
        schema = pa.schema([("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("n", pa.int64()), ("control", pa.binary()), ("data", pa.binary())])
        rank, starts = given.value
        raw, docs_, have, start = [], [], 0, -1

        def row():
            control, data = compress(rank[np.frombuffer(b"".join(raw), kind)])
            values = (start, docs_, [len(x) // width for x in raw], have, control, data)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types)], schema=schema)

        for batch in batches:
            for at, doc, ids, n in zip(*(batch.column(k).to_pylist() for k in range(4))):
                start = int(starts[at]) if start < 0 else start  # a partition is a bucket
                raw.append(plain(ids, n))
                docs_.append(doc)
                have += len(raw[-1]) // width
                if have >= RUN:
                    yield row()
                    raw, docs_, have, start = [], [], 0, start + have
        if raw:
            yield row()

    spark.createDataFrame([(ranked.tobytes(),)], "ids binary").coalesce(1).write.option("compression", "none").parquet(f"{path}/ranks")
    coded = by_id.select("bucket", "doc_id", "ids", "n").mapInArrow(runs, "start long, doc_ids array<long>, counts array<long>, n long, control binary, data binary")
    coded.write.option("compression", "none").parquet(f"{path}/ids")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit integers) from the files."""
    ranked = np.frombuffer(spark.read.parquet(f"{path}/ranks").first()[0], "<u4")  # bounded by the vocabulary
    shared = spark.sparkContext.broadcast(ranked)

    def unpack(batches):
        for batch in batches:
            for start, docs_, counts, n, control, data in zip(*(batch.column(k).to_pylist() for k in range(6))):
                ids = shared.value[expand(control, data, n)].astype("<u4")
                ends = np.cumsum(counts)
                parts = [ids[e - c : e].tobytes() for e, c in zip(ends.tolist(), counts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs_, pa.int64()), pa.array(start + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(parts, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    files = spark.read.parquet(f"{path}/ids").select("start", "doc_ids", "counts", "n", "control", "data")
    return files.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")


def write_and_read(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from files written under the shared folder."""
    path = shared_path(docs.sparkSession, "token-files")
    write(docs, tokenizer, path, end)
    return read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32(ids: np.ndarray) -> int:
    """What ``write_and_read`` gives for a document's ids."""
    return zlib.crc32(ids.astype("<u4").tobytes())
