"""Encoding, decoding, token files and token counts, against the public libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import bpe, chunks, token_counts, token_files
from tessella.llm.queries import PATTERN, RANKS, TOKENIZER

CODEC = bpe.codec(RANKS, PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=CODEC.machine.ranks, special_tokens={})
OTHER = Tokenizer.from_file(TOKENIZER)
OTHER.encode_special_tokens = True
CASES = [(7, "Hello world"), (3, None), (3, ""), (None, "no id"), (None, "no id"), (1, "  two  spaces \n\n and\tté 漢字🙂 <|endoftext|>"), (9, "ab" * 40_000), (8, "lots of words " * 20_000)]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("abcXYZ 's\n\t\r  é漢🙂12.,!?-_\x1c\x85́"), max_size=60))
def test_encoding_equals_the_libraries(text):
    ids = CODEC.encode(text).tolist()
    assert ids == LIBRARY.encode_ordinary(text)
    assert np.frombuffer(token_files.encoder(TOKENIZER).text(text), "<u4").tolist() == OTHER.encode(text, add_special_tokens=False).ids == ids


@pytest.mark.parametrize("text", ["a" * 3000, " " * 700, "-" * 900, "\n" * 50 + "x", "The" * 500, "".join(random.Random(1).choices("etaoin", k=5000))])
def test_long_pieces(text):
    assert CODEC.encode(text).tolist() == LIBRARY.encode_ordinary(text)


def test_a_full_table_starts_anew():
    small = bpe.MergeTransducer(CODEC.machine.ranks, max_states=50)
    rng = random.Random(2)
    for _ in range(300):
        piece = "".join(rng.choices("abcdefgh", k=12)).encode()
        assert small.encode(piece) == CODEC.machine.encode(piece)
    assert len(small.states) <= 51


def test_every_token_is_its_own_encoding():
    assert all(CODEC.machine.encode(t) == [i] for t, i in CODEC.machine.ranks.items())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80), st.integers(1, 5))
def test_streamed_decoding(text, part):
    text = text.encode("utf-8", "replace").decode()
    ids = CODEC.encode(text)
    assert CODEC.decode(ids, part) == text.encode()
    stream = bpe.StreamDecoder(CODEC)
    for k in range(0, len(ids), part):
        stream.feed(ids[k : k + part]).decode()  # whole characters only
    stream.close()


def test_bad_bytes_are_refused():
    byte = lambda b: CODEC.machine.ranks[bytes([b])]
    for ids in ([byte(0xFF)], [byte(0xC3)], [byte(0xE2), byte(0x28)], [byte(0xED), byte(0xA0), byte(0x80)]):
        with pytest.raises(ValueError):
            CODEC.decode(np.array(ids, "<u4"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CASES, "doc_id long, text string").repartition(4)


def test_round_trip(docs):
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(docs.withColumn("n_tokens", F.lit("x")), RANKS, PATTERN).collect())
    expected = []
    for i, t in CASES:
        ids = LIBRARY.encode_ordinary(t or "")
        expected.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(expected)
    texts = sorted(r["text"] for r in bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).collect())
    assert texts == sorted(t or "" for _, t in CASES)
    assert bpe.round_trip(docs.limit(0), RANKS, PATTERN).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, (1 << 32) - 1), max_size=70))
def test_variable_length_coding(values):
    ranks = np.array(values, np.uint32)
    control, data = token_files.compress(ranks)
    assert len(control) == -(-len(values) // 4)
    assert len(data) == sum(max(1, (v.bit_length() + 7) // 8) for v in values)
    assert token_files.expand(control, data, len(values)).tolist() == values


@pytest.mark.parametrize("bucket", [1, 2, 8192])
def test_token_files(spark, docs, bucket):
    path = token_files.shared_path(spark, "test")
    token_files.write(docs, TOKENIZER, path, bucket=bucket)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], zlib.crc32(r["ids"])) for r in token_files.read(spark, path).collect())
    assert [r[1] for r in got] == sorted((i for i, _ in CASES), key=lambda i: (i is not None, i))
    ends = np.cumsum([r[2] for r in got])
    assert [r[0] for r in got] == [0, *ends[:-1].tolist()]
    expected = sorted(zlib.crc32(np.array(OTHER.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for _, t in CASES)
    assert sorted(r[3] for r in got) == expected


def test_no_documents_make_no_tokens(spark, docs):
    assert token_files.write_and_read(docs.limit(0), TOKENIZER).count() == 0


def test_histogram(spark, docs):
    lengths = [len(OTHER.encode(t or "", add_special_tokens=False).ids) for _, t in CASES] + [300, 300]
    hist = token_counts.histogram(token_counts.lengths(docs, TOKENIZER).unionByName(spark.createDataFrame([(300,), (300,)], "length long"))).cache()
    for r in hist.collect():
        limit = r["length"]
        assert r["docs"] == lengths.count(limit) and r["docs_at_least"] == sum(x >= limit for x in lengths)
        assert r["tokens_at_least"] == sum(x for x in lengths if x >= limit)
        assert r["truncated_tokens"] == sum(min(x, limit) for x in lengths)
        assert r["share_not_longer"] == pytest.approx(sum(x <= limit for x in lengths) / len(lengths))
    for limit in (0, 1, 2, 100, 299, 301, 10**6):
        assert token_counts.truncated_total(hist, limit) == sum(min(x, limit) for x in lengths)
    for q in (0.1, 0.5, 0.9, 1.0):
        assert token_counts.quantile(hist, q) == sorted(lengths)[max(0, int(np.ceil(q * len(lengths))) - 1)]
    assert token_counts.histogram(token_counts.lengths(docs.limit(0), TOKENIZER)).count() == 0
    clashing = docs.withColumns({"length": F.lit("x"), "docs": F.lit(1), "tokens": F.lit(2)})
    assert token_counts.histogram(token_counts.lengths(clashing, TOKENIZER)).agg(F.sum("docs")).first()[0] == len(CASES)


@pytest.mark.parametrize("hot", [None, 77])
def test_part_files_ascend_without_overlap(spark, hot):
    """Half of the rows share a doc_id; they fill several files."""
    rows = [(hot if i % 2 else i, f"text {i % 37} of {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    docs = docs.withColumns({"ids": F.lit("x"), "bucket": F.lit(1), "start": F.lit(2)})
    path = token_files.shared_path(spark, "ascending")
    token_files.write(docs, TOKENIZER, path, bucket=40)
    files = spark.read.parquet(f"{path}/ids").select(F.input_file_name().alias("f"), "start", "doc_ids").collect()
    parts = [[x for r in sorted(files, key=lambda r: r["start"]) if r["f"] == f for x in r["doc_ids"]] for f in sorted({r["f"] for r in files})]
    flat = [-1 if x is None else x for p in parts for x in p]
    assert flat == sorted(-1 if x is None else x for x, _ in rows)
    assert len(parts) >= 8 and max(map(len, parts)) < 120
    assert token_files.read(spark, path).agg(F.max(F.col("start") + F.col("n_tokens")), F.sum("n_tokens")).first()[0] == token_files.read(spark, path).agg(F.sum("n_tokens")).first()[0]


def test_odd_white_space_and_latin_words_take_the_short_path(monkeypatch):
    """Plain searches find what the pattern of white space does; no Latin word is cut by the general path."""
    import random
    import re

    import public_tokenizers
    from tokenizers import Tokenizer

    from tessella.llm import chunks, token_files

    ws = chunks._WS
    pattern = re.compile(f"[{ws}][{ws}]|\\A[{ws}]|[{ws}]\\Z|[\t\v-\r\x85\xa0" + ws[6:] + "]")
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choices("ab\u00e9\u4e00" + rng.choice([" \n", " \n\t", " \u2003\n", "\x85\x1c ", "\u3000\u200b "]), k=rng.randrange(1, 9)))
        assert chunks.odd(text) == bool(pattern.search(text))
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), token_files.Encoder(path)
    words = ["\u00e9t\u00e9", " \u00e9t\u00e9", " na\u00efve,", "\u00c9t\u00e9.", " \u0159e\u010d", " stra\u00dfe!", "plain", " plain?", " \u4e2d\u6587."]
    for w in words:
        assert encoder.text(w) == token_files.np.array(library.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
    monkeypatch.setattr(encoder, "_cut", lambda chunk: 1 / 0)
    for w in (" h\u00e9las", " h\u00e9las;", "Gr\u00f6\u00dfe"):
        assert encoder._chunk(w)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("abZ 's\n\n  é漢🙂12.,!\x85"), max_size=40)), max_size=8))
def test_texts_that_are_cut_together_have_the_ids_they_have_alone(texts):
    encoder = token_files.encoder(TOKENIZER)
    assert encoder.texts(texts) == [encoder.text(t) for t in texts]


def test_a_word_is_looked_up_once_for_many_texts():
    """op6: 409 CPU seconds a GB of 400 when each of a text's words was looked up."""

    class Counted(chunks.Recent):
        asked = 0

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

    encoder = token_files.Encoder(TOKENIZER)
    encoder.spaced = Counted(encoder._joined, 1000)
    texts = [f"one two three\nfour {k % 10}" for k in range(500)]
    assert encoder.texts(texts) == [encoder.text(t) for t in texts]
    encoder.spaced.asked = 0
    encoder.texts(texts)
    assert encoder.spaced.asked == 14  # 4 words and 10 numbers


@pytest.mark.parametrize("n", [0, 1, 3, 4, 1001])
def test_codes_of_every_width(n):
    ranks = (2 ** (np.random.default_rng(n).random(n) * 32)).astype(np.uint32)
    control, data = token_files.compress(ranks)
    sizes = [max(1, -(-int(r).bit_length() // 8)) for r in ranks]
    assert data == b"".join(int(r).to_bytes(s, "little") for r, s in zip(ranks, sizes))
    assert [control[k // 4] >> 2 * (k % 4) & 3 for k in range(n)] == [s - 1 for s in sizes]
    assert (token_files.expand(control, data, n) == ranks).all()
