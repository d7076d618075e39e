"""Vector codes, conversation tries and substring dedup against brute force and on odd tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import elkan, substrings, trie

EMPTY = hashlib.sha256(b"").hexdigest()


# --- vector codes --------------------------------------------------------------------------------


def brute_codes(rows, rounds=elkan.ROUNDS):
    rows = sorted(rows, key=lambda r: r[0])
    x = np.floor(np.array([r[1] for r in rows], np.float64) * 1024).astype(np.int64)
    width = x.shape[1] // 4
    books = [x[:256, p * width : (p + 1) * width].copy() for p in range(4)]
    for k in range(rounds + 1):
        near, best = [], []
        for p in range(4):
            d = ((x[:, None, p * width : (p + 1) * width] - books[p][None]) ** 2).sum(2)
            near.append(d.argmin(1))
            best.append(d.min(1))
            for e in range(len(books[p])) if k < rounds else ():
                if (near[p] == e).any():
                    books[p][e] = x[near[p] == e, p * width : (p + 1) * width].sum(0) // (near[p] == e).sum()
    error = sum(best)
    of = defaultdict(int)
    for r, e in zip(rows, error):
        of[r[2]] += int(e)
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    return sorted((r[0], "".join("%02x" % n[i] for n in near), int(error[i]), of[r[2]], sha) for i, r in enumerate(rows))


def collected(df):
    return sorted((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def test_codes_with_ties_and_copies(spark):
    rng = random.Random(5)
    # few distinct values: many equal distances, equal vectors and entries that nothing uses
    rows = [(i, [rng.choice([-0.5, -0.001, 0.25, 1.0]) for _ in range(8)], rng.choice([1, 2, None])) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    assert collected(elkan.codes(df)) == brute_codes(rows)


def test_codes_of_clusters_measure_little(spark):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(40, 16))
    x = np.floor(1024 * (middle[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 16)) / 50)).astype(np.int64)
    book = x[:256].copy()
    part = elkan.Part(book)
    entry, d, lower = part.first(x)
    new = book.copy()
    for e in np.unique(entry):
        new[e] = x[entry == e].sum(0) // (entry == e).sum()
    packed, unit = elkan.pack(lower)
    held = packed * unit[:, None].astype(np.float64)
    assert (held <= lower).all()
    after = elkan.Part(new, elkan.up(elkan.squares(book, new)))
    got, best, bounds, measured = after.next(x, entry, elkan.up(d), held)
    every = elkan.all_squares(x, new)
    assert (got == every.argmin(1)).all() and (best == every.min(1)).all() and (bounds <= np.sqrt(every) + 1e-9).all()
    assert measured < 0.25 * every.size


def test_codes_of_large_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8) * 40_000).tolist(), 0) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert collected(elkan.codes(df)) == brute_codes(rows)


def test_codes_of_odd_rows(spark):
    rows = [(1, [0.5] * 8, None), (2, [0.5] * 8, None), (None, [1.0] * 8, 3), (3, None, 1), (4, [None] * 8, 1), (5, [float("nan")] * 8, 1), (6, [float("inf")] * 8, 1), (7, [1e9] * 8, 1), (8, [1.0] * 4, 1), (9, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"x": F.lit("x"), "entry": F.lit(0), "error": F.lit(9), "v": F.lit(1)})
    got = {r["vec_id"]: r for r in elkan.codes(df).collect()}
    # equal entries: the lower index; the null vec_id is the last entry
    assert {k: r["code"] for k, r in got.items()} == {1: "00000000", 2: "00000000", None: "02020202"}
    assert all(r["error"] == 0 and r["label_error"] == 0 for r in got.values())
    none = elkan.codes(df.where("vec_id > 100"))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


# --- conversation trie ---------------------------------------------------------------------------


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, role, sha, text))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    out = []

    def total(path):
        own = (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
        below = [total(k) for k in kids[path]]
        leaves, saved = sum(b[0] for b in below) or 1, own + sum(b[1] for b in below)
        ends = [c for c in members[path] if len(whole[c]) == len(path)]
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((members[path][0], len(path), members[path[:-1]][0] if path else None, len(members[path]), len(kids[path]), leaves, saved, sha))
        return leaves, saved

    if members:
        total(())
    return sorted(out, key=repr)


def made_conversations(seed, n=260):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(700), n):
        turns = rng.choice([0, 1, 3, 9, 9, 14])
        same = rng.random() < 0.5
        for t in range(turns + 1):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", None, ""]), f"t{t}" if same else rng.choice(["a", "b", "é" * 5, None, ""])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"
NODE = [c.split()[0] for c in trie._NODE.split(", ")]


def trie_of(df, **more):
    return sorted((tuple(r[c] for c in NODE) for r in trie.nodes(df, **more).collect()), key=repr)


@pytest.mark.parametrize("local", [25, trie.LOCAL])
def test_trie(spark, local):
    rows = made_conversations(local)
    assert trie_of(spark.createDataFrame(rows, SCHEMA).repartition(3), local=local) == brute_trie(rows)


def test_trie_of_one_long_conversation_and_copies(spark):
    rows = [(0, t, "u", f"x{t}") for t in range(3000)] + [(c, t, "u", f"y{t}") for c in range(1, 60) for t in range(12)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"bucket": F.lit(1), "pos": F.lit("x"), "_range0": F.lit(2), "parent": F.lit(3)})
    found = trie_of(df, local=400)
    by = {(r[0], r[1]): r for r in found}
    leaf = max(r[1] for r in found if r[0] == 0)
    assert leaf == 3000 and by[(0, 3000)][3:6] == (1, 0, 1) and by[(0, 0)][3] == 60
    # the recursion of brute force is too deep here: SQL instead, over the short ones
    short = [r for r in rows if r[0] or r[1] < 30]
    duck = duckdb.connect()
    import pandas as pd

    frame = pd.DataFrame(short, columns=["conv_id", "turn", "role", "text"])  # noqa: F841  DuckDB reads it
    duck.execute("create table conversations as select * from frame")
    cursor = duck.execute(trie.SQL)
    names = [d[0] for d in cursor.description]
    expected = sorted((tuple(r[names.index(c)] for c in NODE) for r in cursor.fetchall()), key=repr)
    assert trie_of(spark.createDataFrame(short, SCHEMA), local=60) == expected == brute_trie(short)


def test_trie_of_odd_tables(spark):
    assert trie_of(spark.createDataFrame([], SCHEMA)) == []
    assert trie_of(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)) == []
    rows = [(150, 1, None, None), (150, 1, None, None), (-250, None, "a", "z" * 100_000), (-200, 5, "a", "b"), (7, 2**40, "a", "b")]
    expected = trie_of(spark.createDataFrame(rows, SCHEMA), local=1)
    assert expected == trie_of(spark.createDataFrame(rows, SCHEMA))
    assert sum(r[3] for r in expected if r[1] == 0) == 4


# --- substring dedup -----------------------------------------------------------------------------


def brute_rest(rows, window):
    docs = [(substrings.LAST if d is None else d, d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for doc, _, w in docs:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(doc, first.get(k, doc))
    out = []
    for doc, doc_id, w in docs:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = " ".join(x.decode() for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), kept))
    return sorted(out, key=repr)


def rest(df, *args):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remaining(df, *args).collect()), key=repr)


@pytest.mark.parametrize("shard_words, served_words", [(substrings.SHARD_WORDS, substrings.SERVED_WORDS), (300, 400)])
def test_substrings(spark, shard_words, served_words):
    rng = random.Random(shard_words)
    word = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(4)) for _ in range(n)]
    passages = [word(n) for n in (11, 12, 13, 20, 60)]
    rows = []
    for i in range(300):
        w = word(rng.randrange(30))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(4)
            w += p[a : len(p) - rng.randrange(4)] + word(rng.randrange(20))
        rows.append((rng.choice([None, i, i, i, i + 3]), " ".join(w)))
    rows += [(1000 + i, " ".join(["x"] * (10 + i))) for i in range(20)] + [(2000 + i, " ".join(passages[4] * 4)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rest(df, 12, 5, shard_words, served_words) == brute_rest(rows, 12)


def test_substrings_by_the_production_window(spark):
    rng = random.Random(9)
    word = lambda n: [rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(n)]
    common, rows = word(55), []
    for i in range(120):
        rows.append((i, " ".join(word(rng.randrange(90)) + common[i % 9 : 55 - i % 3] + word(rng.randrange(90)))))
    rows += [(500, " ".join(word(20_000))), (501, rows[3][1]), (502, "\t".join(rows[4][1].split()) + "\x0b"), (503, rows[5][1].replace(" ", "\xa0", 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_rest(rows, 50)
    assert rest(df) == expected and sum(r[2] for r in expected) > 3000


def test_substrings_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert rest(spark.createDataFrame([], schema)) == []
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \t"), (None, long), (None, long), (5, long), (5, long), (9, long + " x")]
    df = spark.createDataFrame(rows, schema).withColumns({"rid": F.lit("r"), "doc": F.lit("d"), "spans": F.lit(1), "shard": F.lit(2), "unnamed": F.lit(True)})
    found = rest(df)
    assert found == brute_rest(rows, 50)
    assert sum(r[2] for r in found) == 180  # the nulls' copies and the last one's, not those of the equal ids


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_conversation_trie", "op13_substring_dedup"])
def test_sql(spark, small, name):
    from tessella.llm.queries import QUERIES, SQL

    duck = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        duck.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = QUERIES[name](spark, small)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted((tuple(r[names.index(c)] for c in df.columns) for r in cursor.fetchall()), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == expected


def test_empty_sha():
    assert trie.NONE == EMPTY
