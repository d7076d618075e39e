"""Exact and near deduplication, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import components, exact_dedup, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CASES = [
    (5, "same text here twice now", "en", "a", 1),
    (9, "same text here twice now", None, None, None),
    (9, "same text here twice now", "en", "a", 1),
    (1, "Same text here twice now", "en", "a", 1),
    (2, None, "en", "a", 0),
    (3, "", "en", "b", 0),
    (None, "", "en", "b", 0),
    (None, "only null ids", "en", "b", 0),
    (4, "  \t\n ", "en", "b", 3),
    (6, "one", "en", "b", 3),
    (7, "é à ü ß   x y z", "fr", "b", 3),
    (8, "word " * 30_000, "en", "b", 150_000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CASES, SCHEMA).repartition(5)


def test_exact_groups(docs):
    got = [r.asDict() for r in exact_dedup.exact_groups(docs).collect()]
    assert len(got) == len(CASES)
    texts = {}
    for doc_id, text, *_ in CASES:
        texts.setdefault(hashlib.sha256((text or "").encode()).hexdigest(), []).append(doc_id)
    for r in got:
        ids = texts[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
    for h in texts:
        assert sum(r["kept"] for r in got if r["text_sha256"] == h) == 1
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


@pytest.mark.parametrize("largest, expected", [(True, 9), (False, 1)])
def test_largest_or_smallest(spark, largest, expected):
    d = spark.createDataFrame([(i, "t") for i in range(1, 10)], "doc_id long, text string").repartition(7)
    assert {r["keep_id"] for r in exact_dedup.exact_groups(d, largest, fan_in=2).collect()} == {expected}


def test_drop_copies_keeps_rows_whole(docs):
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    assert sorted(r["text"] or "" for r in got.collect()) == sorted({t or "" for _, t, *_ in CASES})


def test_empty_table_and_other_columns(spark, docs):
    extra = docs.withColumns({"_sha": F.lit(1), "kept": F.lit("x"), "keep_id": F.lit(0), "fp": F.lit(2), "component_id": F.lit(3), "root": F.lit(1)})
    assert exact_dedup.exact_groups(extra).count() == len(CASES)
    assert simhash.near_groups(extra).count() == len(CASES)
    for f in (exact_dedup.exact_groups, exact_dedup.drop_copies, simhash.near_groups, simhash.drop_near_copies):
        assert f(docs.limit(0)).count() == 0
    assert simhash.drop_near_copies(extra).columns == extra.columns


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(pairs, least):
    """doc -> smallest reachable doc, links by Hamming distance."""
    root = {i: i for i, _ in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, p) in enumerate(pairs):
        for b, q in pairs[:i]:
            if (p ^ q).bit_count() <= least:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {a: find(a) for a, _ in pairs}


def test_near_groups_match_brute_force(spark):
    rng = random.Random(3)
    data = []
    for k in range(60):
        words = [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(30)) for _ in range(rng.choice([0, 1, 3, 5, 80, 400]))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                if copy:
                    copy[rng.randrange(len(copy))] = "edit"
            data.append((len(data), rng.choice([" ", "  ", "\n"]).join(copy)))
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    expected = plain_groups([(i, plain_fingerprint(t)) for i, t in data], 4)
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_groups(d).collect()}
    assert got == {i: (plain_fingerprint(t), expected[i]) for i, t in data}


def test_null_ids_never_name_a_component(docs):
    got = simhash.near_groups(docs).collect()
    assert len(got) == len(CASES)
    empty = [r for r in got if r["fp"] == 0]
    assert len(empty) == 4 and {r["component_id"] for r in empty} == {2}
    alone = [r for r in got if r["doc_id"] is None and r["fp"] != 0]
    assert [r["component_id"] for r in alone] == [None]


@pytest.mark.parametrize("spread", [0, 2, 6])
def test_cells_lose_no_link(spark, spread):
    """Fingerprints around a few centres, in cells large and small."""
    rng = np.random.default_rng(spread)
    centres = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fps = set()
    for c in centres:
        for _ in range(120):
            x = int(c)
            for b in rng.integers(0, 64, spread):
                x ^= 1 << int(b)
            fps.add(x)
    fps |= {0, 1, (1 << 64) - 1, (1 << 63)}
    signed = [int(np.array([x], np.uint64).view(np.int64)[0]) for x in fps]
    d = spark.createDataFrame([(0, s) for s in signed], "family int, fp long")
    edges = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.link_edges(d).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    expected, root = plain_groups([(x, x) for x in fps], 4), {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {x: find(x) for x in fps} == expected


def test_manhattan_distance_is_a_lower_bound():
    x = np.random.default_rng(0).integers(0, 1 << 63, 2000, dtype=np.uint64)
    a, b = x[::2], x[1::2]
    pairs = lambda v: np.stack([((v >> np.uint64(2 * k)) & np.uint64(1)) + ((v >> np.uint64(2 * k + 1)) & np.uint64(1)) for k in range(32)]).astype(int)
    manhattan = np.abs(pairs(a) - pairs(b)).sum(0)
    assert (np.bitwise_count(simhash.embed(a) ^ simhash.embed(b)) == manhattan).all()
    assert (manhattan <= np.bitwise_count(a ^ b)).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (7, 7), (-5, 300), (300, -9)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, -5: -9, 300: -9, -9: -9}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_share_shingles(spark):
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    data, groups = [], []
    for n in (60, 120, 400):
        for _ in range(6):
            base = text(n)
            edited = list(base)
            edited[n // 2] = "changed"
            far = base[: n // 2] + text(n // 2)
            groups.append((len(data), len(data) + 1, len(data) + 2))
            data += [(len(data) + i, " ".join(t)) for i, t in enumerate((base, edited, far))]
    kept = {r["doc_id"] for r in simhash.drop_near_copies(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(a in kept and c in kept for a, _, c in groups)
    assert sum(b in kept for _, b, _ in groups) <= 1


def test_rows_without_id_stay(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in simhash.drop_near_copies(d).collect()) == ["1", "None", "None"]


def plain_kept(data, least=0.8, shingle=5):
    """Ids that stay if all pairs of shingle sets are compared."""
    sets = []
    for _, t in data:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))})
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, p in enumerate(sets):
        for j in range(i):
            if len(p & sets[j]) >= least * len(p | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {data[i][0] for i in range(len(data)) if root[i] == i}


def test_near_copies_of_a_hot_text(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"w{rng.randrange(9000)}" for _ in range(150)]
    data = []
    for k in range(300):
        edited = list(base)
        for at in rng.sample(range(4), 1):
            for x in range(at * 9, 150, 50):
                edited[x] = f"e{k}"
        for x in rng.sample(range(150), 2):
            edited[x] = f"f{k}"
        data.append((k, " ".join(edited)))
    data.append((300, " ".join(base)))
    data += [(301 + k, " ".join(base[:20] + [f"x{k}_{i}" for i in range(60)])) for k in range(40)]
    expected = plain_kept(data)
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    assert {r["doc_id"] for r in simhash.drop_near_copies(d).collect()} == expected
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 5000)
    assert {r["doc_id"] for r in simhash.drop_near_copies(d).collect()} == expected


def test_near_copies_of_every_kind(spark):
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(6000)}" for _ in range(n)]
    texts = ["", None, "one", "one two", "One  two"]
    for n in (6, 9, 12, 20, 30, 60, 120, 400):
        for _ in range(12):
            t, k, at = words(n), max(1, n * rng.randrange(5, 25) // 100), rng.randrange(n)
            texts.append(" ".join(t))
            texts.append(" ".join(t + words(k)))
            texts.append(" ".join(t[: n - k]))
            texts.append(" ".join(t[:at] + words(k) + t[at + k :]))
            texts.append(" ".join(words(k) + t))
    data = list(enumerate(texts))
    expected = plain_kept(data)
    assert len(data) - len(expected) > 80
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    assert {r["doc_id"] for r in simhash.drop_near_copies(d).collect()} == expected


def test_stages_keep_columns_of_any_name(spark):
    """Every name that the stages use inside, as a column of the user's."""
    from tessella.llm import exact_dedup, mixing, simhash, toxicity

    names = ["_sha", "_bytes", "_check", "_run", "_row", "_keep", "_n", "_keep_id", "_id", "_unnamed", "_key", "_text", "_copies", "_rest", "_rank", "_time", "copies", "text_hash", "node", "root", "fp", "a", "b", "place", "task", "score", "predicted", "held_out", "toxic", "a.b", "size", "target", "block", "p", "_"]
    rows = [(i, f"text {i // 2} of some words " * 9, "s", *[f"{n}{i}" for n in names]) for i in range(12)]
    d = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    every = {r["doc_id"]: r for r in d.collect()}
    for out in (exact_dedup.drop_copies(d), mixing.take(d), simhash.drop_near_copies(d), toxicity.drop_toxic(d, labels)):
        got = out.collect()
        assert out.columns == d.columns and all(r == every[r["doc_id"]] for r in got)
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(d).collect()) == [1, 3, 5, 7, 9, 11]


def test_the_pipeline_links_by_fingerprints(spark, monkeypatch):
    """The near-copy stage takes op2's links, verifies them, and verifies no pair that they have joined again."""
    import corpus_pipeline

    rng = random.Random(17)
    words = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    data = []
    for _ in range(8):
        line, text, long = words(11) * 60, words(60), words(900)
        # a line often repeated: equal fingerprints, few shingles in common; words appended: near copies by shingles alone; one word changed: both
        data += [line + words(20), line + words(20), text, text + words(12), long, [*long[:400], "changed", *long[401:]]]
    data = [(i, " ".join(t)) for i, t in enumerate(data)] + [(60, ""), (61, None), (None, "no id")]
    known = [(i, t) for i, t in data if i is not None]
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    pairs = {(r["a"], r["b"]) for r in simhash.fingerprint_pairs(d.where("doc_id IS NOT NULL")).collect()}
    groups = plain_groups([(i, plain_fingerprint(t)) for i, t in known], 4)
    assert {b: a for a, b in pairs} == {i: r for i, r in groups.items() if i != r} and {(k, k + 1) for k in range(0, 48, 6)} <= pairs
    asked, verified = [], simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda ids, p, *rest: asked.append({(r["a"], r["b"]) for r in p.collect()}) or verified(ids, p, *rest))
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup_filter(spark, d, "").collect()} == plain_kept(known) | {None}
    by_fingerprint, others = asked
    assert by_fingerprint == pairs and not others & {p for p in pairs if p[0] % 6 == 4}
    assert {(k, k + 1) for k in range(2, 48, 6)} & others
