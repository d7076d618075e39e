import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import diff, filters, history, ranking


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_canonical_row_ignores_input_order(spark):
    data = [("g", 1, 5, "u"), ("g", 2, 9, ""), ("g", 3, 9, "u"), ("h", 4, 1, None), ("g", 5, 9, "u")]
    seen = set()
    for seed in range(3):
        random.Random(seed).shuffle(data)
        d = spark.createDataFrame(data, "g string, id int, n int, s string")
        one = ranking.canonical(d, ["g"], [-F.col("n"), F.coalesce("s", F.lit("")) == ""], "id")
        seen.add(str(rows(one, "g", "id", "n_duplicates")))
        every = ranking.kept_rows(d, ["g"], [-F.col("n"), F.coalesce("s", F.lit("")) == ""], "id")
        assert rows(every, "id", "kept_id") == [(1, 3), (2, 3), (3, 3), (4, 4), (5, 3)]
    assert seen == {"[('g', 3, 3), ('h', 4, 0)]"}


def test_families_keep_the_first_of_equals(spark):
    d = spark.createDataFrame([("f", 2, 7), ("f", 1, 7), ("f", 3, 9), ("e", 9, 1)], "f string, id int, s int")
    got = {r["f"]: (r["best_id"], [v["id"] for v in r["variants"]]) for r in ranking.families(d, "f", "s", "id").collect()}
    assert got == {"f": (3, [3, 1, 2]), "e": (9, [9])}


def test_greedy_budget_passes_over_what_does_not_fit(spark):
    d = spark.createDataFrame([("a", 1, 4, False), ("a", 2, 9, False), ("a", 3, 3, False), ("a", 4, 99, True), ("a", 5, 4, False)], "g string, o int, c int, free boolean")
    got = {r["o"]: r["selected"] for r in ranking.greedy_budget(d, "g", "o", "c", 10, "free").collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False}


def test_hot_groups(spark):
    """One group holds half of the rows."""
    d = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), F.col("id").alias("o"), (F.col("id") % 10 + 1).alias("c"))
    f = {r["g"]: r for r in ranking.families(d, "g", "c", "o", 3).where("g = 'hot'").collect()}["hot"]
    assert f["n"] == 2000 and [v["id"] for v in f["variants"]] == [8, 18, 28]
    spent, expected = 0, set()
    for i in range(0, 4000, 2):
        if spent + i % 10 + 1 <= 100:
            spent, expected = spent + i % 10 + 1, expected | {i}
    taken = ranking.greedy_budget(d, "g", "o", "c", 100).where("selected").collect()
    assert {r["o"] for r in taken if r["g"] == "hot"} == expected and len(taken) == 2000 + len(expected)


def test_top_ranks_the_first_k(spark):
    d = spark.createDataFrame([(i, i % 4) for i in range(12)], "id int, s int")
    got = ranking.top(d, [F.desc("s"), F.asc("id")], 5)
    assert rows(got, "id", "rank") == [(11, 3), (2, 4), (3, 1), (6, 5), (7, 2)]


@pytest.mark.parametrize("keep, signal, expected", [("a", "x", 1), ("none", "x", 3), ("a", "", 3)])
def test_filter_with_fallback(spark, keep, signal, expected):
    d = spark.createDataFrame([("a", signal), ("b", signal), ("c", signal)], "v string, s string")
    assert filters.keep_with_fallback(d, F.col("v") == keep, F.col("s") != "").count() == expected
    assert filters.keep_with_fallback(d.limit(0), F.col("v") == keep, F.col("s") != "").count() == 0


def test_diff_is_null_safe_and_gated(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "x", "p"), (3, "x", "p"), (5, "s", "s")], "id int, f string, g string")
    b = spark.createDataFrame([(1, "x", None), (2, "y", "p"), (4, "x", "p"), (5, "s", "t")], "id int, f string, g string")
    assert rows(diff.diff(a, b, "id", ["f", "g"]), "id", "kind", "changed_fields") == [(1, "same", []), (2, "changed", ["f"]), (3, "removed", []), (4, "new", []), (5, "changed", ["g"])]
    assert rows(diff.diff(a, b, "id", ["g"], gate="f").where("kind='changed'"), "id", "changed_fields") == [(2, [])]


def test_delta_of_an_empty_baseline_is_zero(spark):
    a = spark.createDataFrame([], "id int, f string")
    b = spark.createDataFrame([(1, "x")], "id int, f string")
    assert set(diff.delta_counts(a, b, "id", ["f"]).first()) == {0}
    assert diff.delta_counts(b, b, "id", ["f"]).first()["n_same"] == 1


def test_last_and_first_wins(spark):
    d = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "k string, o int, v string")
    assert rows(diff.one_a_key(d, "k", "o"), "v") == [("b",)] and rows(diff.one_a_key(d, "k", "o", last=False), "v") == [("a",)]


def test_duplicates_pair_by_place(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "z")], "id int, l int, f string")
    b = spark.createDataFrame([(1, 1, "x"), (1, 2, "w")], "id int, l int, f string")
    assert rows(diff.pair_duplicates(a, b, "id", ["l"], ["f"]), "k", "kind", "diffs") == [(1, "same", 0), (2, "changed", 1), (3, "removed", 0)]


def test_equality_counts_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "v int")
    r = diff.same_rows(a, spark.createDataFrame([(2,), (1,)], "v int")).first()
    assert (r["n_a"], r["n_b"], r["only_a"], r["only_b"], r["equal"]) == (3, 2, 1, 0, False)
    assert diff.same_rows(a, a.orderBy(F.desc("v"))).first()["equal"]


def test_as_of_is_strictly_before(spark):
    left = spark.createDataFrame([("u", 5, 1), ("u", 7, 2), ("v", 1, 3)], "u string, ts int, id int")
    right = spark.createDataFrame([("u", 5, 50, True), ("u", 3, 30, True), ("u", 6, 60, False)], "u string, ts int, v int, ok boolean")
    assert rows(history.as_of(left, right, "u", "ts", "v"), "id", "prior_v") == [(1, 30), (2, 60), (3, None)]
    assert rows(history.as_of(left, right, "u", "ts", "v", F.col("ok")), "id", "prior_v") == [(1, 30), (2, 50), (3, None)]


def test_prune_plan_keeps_the_newest(spark):
    d = spark.createDataFrame([("p", "2020-01-01", "a"), ("p", "2020-01-02", "b"), ("q", "2010-01-01", "c")], "p string, d string, r string").withColumn("d", F.to_timestamp("d"))
    got = history.prune_plan(d, "p", "d", "r", 5, F.lit("2026-01-01").cast("timestamp"), 30)
    assert rows(got, "r", "prune") == [("a", True), ("b", False), ("c", False)]


def test_islands_and_cache(spark):
    d = spark.createDataFrame([("u", i, f) for i, f in enumerate([1, 1, 0, 1, 1, 1, 0])], "u string, i int, f int")
    assert rows(history.failure_islands(d, "u", ["i"], F.col("f") == 1, 3), "length", "first") == [(3, 3)]
    cache = spark.createDataFrame([("u", 9)], "u string, v int")
    assert rows(history.cached(d.select("u").distinct(), cache, "u", F.col("v") > 8, "v", F.lit(0)), "hit", "v") == [(True, 9)]
    assert rows(history.cached(d.select("u").distinct(), cache, "u", F.col("v") > 9, "v", F.lit(0)), "hit", "v") == [(False, 0)]


def test_risk_is_capped(spark):
    m = spark.createDataFrame([(0.9,)], "x double")
    r = diff.risk(m, [("a", "x", 0.1, 80), ("b", "x", 0.5, 80), ("c", "x", 0.95, 5)]).first()
    assert r["risk_score"] == 100 and r["risk_reasons"] == ["a", "b"]


@pytest.mark.parametrize("folded", [1, 40, 10_000])
def test_greedy_budget_equals_the_sequential_rule(spark, folded):
    """One group holds half of the rows; one is made so that the largest row that fits shrinks by one each time."""
    rng = random.Random(folded)
    data = [("hot", i, rng.choice([0, 1, 3, 17, 90, 400, 999, 1001, None, -2])) for i in range(1500)]
    data += [("slow", i, c) for i, c in enumerate(x for k in range(60) for x in (1, 1000 - k))]
    data += [(None, i, rng.randrange(700)) for i in range(300)] + [(f"g{i % 40}", i, rng.randrange(1200)) for i in range(800)] + [("hot", 7, 5), ("hot", 7, 5), ("hot", None, 2)]
    rng.shuffle(data)
    expected = []
    for g in {r[0] for r in data}:
        spent = 0
        for o, c in sorted(((o, max(0, c or 0)) for k, o, c in data if k == g), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
            fits = spent + c <= 1000
            spent += c if fits else 0
            expected.append((g, o, fits))
    d = spark.createDataFrame(data, "g string, o int, c int").repartition(5)
    assert rows(ranking.greedy_budget(d, "g", "o", "c", 1000, folded=folded), "g", "o", "selected") == sorted(expected, key=repr)


def test_places_and_caps(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.5 else rng.choice(["a", None]), rng.randrange(50), i) for i in range(900)]
    d = spark.createDataFrame(data, "g string, s int, i int").withColumns({"_range0": F.lit(1), "_place0": F.lit(2), "_nth0": F.lit(3), "c": F.lit(4)}).repartition(7)
    order = [F.desc("s"), F.asc("i")]
    expected = []
    for g in ("hot", "a", None):
        expected += [(g, i, k) for k, (_, i) in enumerate(sorted((-s, i) for x, s, i in data if x == g))]
    found = ranking.positions(d, ["g"], order)
    assert rows(found, "g", "i", "position") == sorted(expected, key=repr) and found.columns == [*d.columns, "position"]
    first = [i for _, i in sorted((-s, i) for _, s, i in data)][:333]
    kept = ranking.capped(d, order, 333)
    assert sorted(r["i"] for r in kept.collect()) == sorted(first) and kept.columns == d.columns
    assert ranking.capped(d.limit(0), order, 5).count() == 0
