"""Nearest neighbours, mixing and the pipeline."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import mixing, vamana

# --- nearest neighbours ----------------------------------------------------------------------------

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, x, k=20):
    out = {}
    for i, q in zip(ids, x):
        if i % 20 == 0:
            s = x @ q
            out[i] = [(ids[j], s[j]) for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    return np.arange(1500), x.astype(np.float32).astype(float)


def test_recall_and_scores_over_shards(spark, vectors):
    ids, x = vectors
    d = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], SCHEMA)
    got, expected = {}, brute(ids, x)
    for r in vamana.nearest(d, shard=400).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert got.keys() == expected.keys()
    hits = 0
    for q, near in expected.items():
        assert sorted(got[q]) == list(range(1, 21))
        assert [s for _, s in (got[q][k] for k in range(1, 21))] == sorted((s for _, s in got[q].values()), reverse=True)
        assert all(s == pytest.approx(x[v] @ x[q], abs=1e-9) for v, s in got[q].values())
        hits += len({v for v, _ in near} & {v for v, _ in got[q].values()})
    assert hits / (20 * len(expected)) >= 0.95


def test_copies_and_odd_rows(spark, vectors):
    ids, x = vectors
    rows = [(int(i), x[0].tolist(), 0) for i in range(200)] + [(1000 + i, x[i].tolist(), 0) for i in range(30)]
    rows += [(2000, None, 0), (2020, [], 0), (2040, [0.0] * 24, 0), (2060, [float("nan")] + [1.0] * 23, 0), (2080, [None] + [1.0] * 23, 0), (2100, [float("inf")] * 24, 0), (2120, [1.0], 0), (None, [1.0] * 24, 0)]
    rows += [(1000, x[0].tolist(), 0)]
    d = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit("x"), "key": F.lit(1), "v": F.lit(2)})
    got = {}
    for r in vamana.nearest(d).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in range(0, 200, 20)} | {1000, 1020}
    for q in range(0, 200, 20):
        near = [v for _, v, _ in sorted(got[q])]
        assert near == [i for i in range(21) if i != q][:20]


def test_few_candidates(spark):
    d = spark.createDataFrame([(20, [1.0, 0.0], 0), (1, [0.5, 1.0], 0), (40, [0.2, 0.0], 0)], SCHEMA)
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in vamana.nearest(d).collect())
    assert got == [(20, 1, 1), (20, 2, 40), (40, 1, 20), (40, 2, 1)]
    assert vamana.nearest(d.limit(0)).count() == 0
    assert vamana.nearest(d.where("vec_id = 20")).count() == 0


# --- mixing ----------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def mixture(n=900, seed=2):
    rng = random.Random(seed)
    sources = ["b", "a", None, "é", "z", ""]
    rows = []
    for i in range(n):
        words = max(0, int(rng.lognormvariate(3, 1)) - 2)
        rows.append((i, " ".join(["w"] * words) if words else rng.choice([None, "", " \n"]), "en", "b" if i % 3 == 0 else rng.choice(sources), words))
    return rows


def plain_targets(rows):
    size = {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [s for s in size if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, rest, left = {}, 1.5 * sum(size.values()), set(order)
    while left:
        level = rest / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] >= 2 * size[s]}
        target |= {s: 2 * size[s] for s in full} if full else {s: level * weight[s] for s in left}
        rest -= sum(2 * size[s] for s in full)
        left = left - full if full else set()
    return size, target


@pytest.mark.parametrize("block", [16, 4096])
def test_mixture(spark, block):
    rows = mixture()
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs.repartition(5), block=block).collect()
    size, target = plain_targets(rows)
    assert sorted(r["doc_id"] for r in got) == [r[0] for r in rows]
    for s in size:
        own = [r for r in got if r["source"] == s]
        longest = max(r["size"] for r in own)
        assert own[0]["source_size"] == size[s] and own[0]["target"] == pytest.approx(target[s])
        assert abs(sum(r["size"] * r["copies"] for r in own) - target[s]) <= longest / 2 + 1
    assert all(0 <= r["copies"] <= 2 for r in got)
    again = mixing.mix(docs.repartition(3).sortWithinPartitions(F.desc("doc_id")), block=block).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in again) == sorted((r["doc_id"], r["copies"]) for r in got)


def test_documents_keep_their_chance():
    rng = np.random.default_rng(3)
    p, words = rng.uniform(0.05, 0.95, 40), rng.integers(1, 500, 40).astype(float)
    taken = np.zeros(40)
    for _ in range(4000):
        out = mixing.pivot(p, words, rng.random(40))
        loose = (out > 1e-9) & (out < 1 - 1e-9)
        assert loose.sum() <= 1 and (out * words).sum() == pytest.approx((p * words).sum())
        taken += out
    assert np.abs(taken / 4000 - p).max() < 0.04


def test_taken_rows(spark):
    rows = mixture(200) + [(1, "repeated row", "en", "a", 2)] * 3
    docs = spark.createDataFrame(rows, DOCS).withColumns({"copies": F.lit("x"), "size": F.lit(0), "block": F.lit(1)})
    decided, out = mixing.mix(docs).collect(), mixing.take(docs)
    assert out.columns == docs.columns
    count = lambda pairs: sorted((str(i), n) for i, n in pairs.items() if n)
    expected, got = {}, {}
    for r in decided:
        expected[r["doc_id"]] = expected.get(r["doc_id"], 0) + r["copies"]
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert count(got) == count(expected)


def test_odd_mixtures(spark):
    docs = spark.createDataFrame([(1, None, "en", None, 0), (None, "a b", "en", None, 0), (None, "a b", "en", None, 0)], DOCS)
    got = mixing.mix(docs).collect()
    assert len(got) == 3 and sum(r["size"] * r["copies"] for r in got) == 6
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.take(docs.limit(0)).count() == 0
    assert mixing.mix(docs.where("text IS NULL")).first()["target"] == 0


# --- pipeline --------------------------------------------------------------------------------------


def test_pipeline_stages(spark, small):
    import corpus_pipeline
    from tessella.llm.shared import load, shared_path

    docs = load(spark, small, "documents")
    columns = docs.columns
    assert len(corpus_pipeline.STAGES) == 5
    sizes = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = shared_path(spark, "pipeline-test")
        stage(spark, docs, small).write.parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
        assert (docs.columns == columns) == (k < 4)
    assert sizes[0] >= sizes[1] >= sizes[2] > 0 and sizes[3] == sizes[4]
    assert corpus_pipeline.run(spark, small).count() == sizes[4]


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage on its own input, on a table with copies, near copies, nulls, long texts and clashing labels."""
    import tiktoken

    import corpus_pipeline
    from tessella.llm import toxicity
    from tessella.llm.queries import PATTERN, RANKS
    from tests.llm.test_dedup import plain_kept

    rng = random.Random(21)
    words = [f"w{k}" for k in range(900)]
    rows = []
    for i in range(240):
        text = rng.choices(words, k=rng.randrange(6, 120))
        if i % 5 == 0:
            text.insert(2, "idiotic")
        rows.append((i, " ".join(text), "en", rng.choice(["a", "b", None]), 1))
    rows += [(1000 + i, t, *rest) for i, (_, t, *rest) in enumerate(rows[:60])]  # exact copies
    rows += [(2000 + i, t + " and more", *rest) for i, (_, t, *rest) in enumerate(rows[100:160])]  # near copies
    rows += [(3000, None, "en", "a", 0), (3001, "", "en", "b", 0), (3002, "long " * 30_000, "en", "b", 0), (3002, "long " * 30_000, "en", "b", 0), (None, "no id here", "en", None, 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int("idiotic" in (t or ""))) for i, t, *_ in rows if i is not None and i < 240], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage-{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage-{k}")
        seen.append([tuple(r) for r in docs.collect()])
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    machine = toxicity.train(given, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scores = {r["text"]: r["s"] for r in given.select("text", toxicity.score(F.col("text"), machine).alias("s")).collect()}
    assert sorted(seen[0], key=key) == sorted((r for r in rows if scores[r[1]] < 0.5), key=key) and len(seen[0]) < len(rows) - 60
    best = {}
    for r in seen[0]:
        if (r[1] or "") not in best or (r[0] is not None and (best[r[1] or ""] is None or r[0] > best[r[1] or ""])):
            best[r[1] or ""] = r[0]
    assert sorted(((r[0], r[1] or "") for r in seen[1]), key=key) == sorted(((i, t) for t, i in best.items()), key=key)
    kept = plain_kept(sorted((r[0], r[1]) for r in seen[1] if r[0] is not None))
    assert {r[0] for r in seen[2]} == kept | {None} and len(seen[2]) < len(seen[1]) - 20
    copies = {}
    for r in seen[3]:
        copies[r] = copies.get(r, 0) + 1
    assert set(copies) <= set(seen[2]) and max(copies.values()) <= 2
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=__import__("tessella.llm.bpe", fromlist=["bpe"]).read_ranks(RANKS), special_tokens={})
    assert sorted((str(r[0]), r[1]) for r in seen[4]) == sorted((str(r[0]), len(library.encode_ordinary(r[1] or ""))) for r in seen[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])


def test_pipeline_without_rows(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
