"""The versioned cache, archived runs, canonical parameters, aliases, and small sinks and readers."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessella.functions import rules, urls
from tessella.operators import cache, diff, filters
from tessella.sources import json_docs, replay, sinks


def test_cache_computes_only_what_it_lacks(spark, tmp_path):
    path = f"{tmp_path}/cache"
    d = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "k string, n int")
    fails = lambda _: F.raise_error(F.lit("computed again")).cast("int")
    out, seen = cache.refreshed(d, path, "k", "v", 1, lambda _: F.col("n") * 10)
    assert sorted(map(tuple, out.collect()), key=repr) == [("a", 1, 10), ("a", 1, 10), ("b", 2, 20), (None, 3, None)] and seen == {"hit": 0, "missing": 2, "outdated": 0, "written": 2}
    out, seen = cache.refreshed(d, path, "k", "v", 1, fails)
    assert seen == {"hit": 2, "missing": 0, "outdated": 0, "written": 0} and out.where("v = 20").count() == 1 and cache.current(spark, path)[1] == 1
    more = spark.createDataFrame([("b", 5), ("c", None)], "k string, n int")
    out, seen = cache.refreshed(more, path, "k", "v", 2, lambda _: F.col("n") + F.coalesce("old_v", F.lit(0)), fallback=F.when(F.col("k") != "c", -1))
    assert sorted(map(tuple, out.collect())) == [("b", 5, 25), ("c", None, None)] and seen == {"hit": 0, "missing": 1, "outdated": 1, "written": 2}
    # the later version counts for earlier ones too; an entry without a value is tried again, and backfilled
    out, seen = cache.refreshed(d.select("k", "n").unionByName(more), path, "k", "v", 1, lambda _: F.lit(None).cast("int"), fallback=F.lit(7))
    assert seen == {"hit": 2, "missing": 0, "outdated": 1, "written": 1} and {r["k"]: r["v"] for r in out.collect()} == {"a": 10, "b": 25, "c": 7, None: None}
    with pytest.raises(PySparkException, match="computed again"):
        cache.refreshed(d, path, "k", "v", 9, fails)
    assert cache.current(spark, path)[1] == 3 and cache.refreshed(d, path, "k", "v", 1, fails)[1]["hit"] == 2
    assert not (tmp_path / "cache" / "generation=1").exists()
    empty, seen = cache.refreshed(d.limit(0), f"{tmp_path}/none", "k", "v", 1, lambda _: F.col("n"))
    assert empty.count() == 0 and seen["written"] == 0


def test_recalculation_finds_what_changed(spark, tmp_path):
    d = spark.range(50).withColumn("x", F.col("id") % 7)
    plan = lambda inputs: inputs["d"].groupBy("x").count()
    replay.archive(str(tmp_path), "r", {"d": d}, plan, {"a": [1, {"b": 0.5}]})
    problems = lambda p, c: {(r["what"], r["name"]): r["problem"] for r in replay.recalculate(spark, str(tmp_path), "r", p, c).where("problem IS NOT NULL").collect()}
    assert problems(plan, {"a": (1.0, {"b": 0.5000001})}) == {}
    assert problems(lambda i: i["d"].groupBy("x").count().where("x > 0"), {"a": 1}) == {("config", ""): "changed", ("output", "recalculated"): "changed"}
    spark.range(3).withColumn("x", F.col("id")).write.mode("append").parquet(f"{tmp_path}/r/inputs/d")
    assert set(problems(plan, {"a": [1, {"b": 0.5}]})) == {("input", "d"), ("output", "recalculated")}
    with pytest.raises(ValueError):
        replay.recalculate(spark, str(tmp_path), "s", plan, {})
    assert replay.signature({"b": 1, "a": True}) == replay.signature({"a": True, "b": 1.0}) != replay.signature({"a": 1, "b": 1})


def test_fingerprints_of_many_large_digests(spark):
    d = spark.range(1000).select(F.lit("f" * 64).alias("h"))
    one = diff.content_fingerprint(d, "h").first()[0]
    assert one == diff.content_fingerprint(d.repartition(3), "h").first()[0] != diff.content_fingerprint(d.limit(999), "h").first()[0]
    assert diff.content_fingerprint(d.limit(0), "h").count() == 1


@pytest.mark.parametrize(
    "url, expected",
    [
        ("HTTP://H.org/a/?B=2&a=%7e1&utm_x=1&%55TM_y=2", "http://h.org/a?a=%7E1&B=2"),
        ("http://h.org?q=a+b&q=a%20b&x", "http://h.org?q=a+b&q=a+b&x"),
        ("http://h.org?b=1&A=1&a=1&B=%zz#f", "http://h.org?A=1&a=1&B=%25zz&b=1"),
        ("http://h.org?=&a==%3D", "http://h.org?=&a=%3D%3D"),
        (" plain ", "plain"),
        (None, None),
    ],
)
def test_parameters_are_decoded_and_ordered_whatever_their_case(spark, url, expected):
    got = spark.createDataFrame([(url,)], "u string").select(urls.canonical(F.col("u"))).first()[0]
    assert got == expected


def test_aliases_use_their_terms_once(spark):
    d = spark.createDataFrame([(["x", "js", "x"],), ([],), (None,)], "t array<string>")
    calls = rules.with_aliases(F.col("t"), {"js": ("javascript", "web"), "x": ("y",)})
    assert [r[0] for r in d.select(calls).collect()] == [["x", "y", "js", "javascript", "web"], [], None]
    costly = rules.with_aliases(F.regexp_extract_all(F.col("s"), F.lit("([a-z]+)"), F.lit(1)), {"js": ("javascript",), "a": ("b",)})
    plan = spark.range(1).select(F.lit("js a").alias("s"), "id").where("id < 9").select(costly.alias("o"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 1


def test_shortlist_puts_deprioritised_rows_last(spark):
    d = spark.createDataFrame([(1, 50, "ok"), (2, 90, "ok"), (3, 99, "ok"), (4, 99, "unavailable"), (5, 10, "ok"), (6, 90, None), (7, 99, "ok")], "id int, score int, status string")
    state = spark.createDataFrame([(3, "deprioritized"), (7, "ignored")], "id int, user_status string")
    assert [r["id"] for r in filters.shortlist(d, state, "id", 20).orderBy("rank").collect()] == [2, 6, 1, 3]
    assert filters.drop_ephemeral(d, ["status", "none"]).columns == ["id", "score"]


def test_small_sinks_and_readers(spark, tmp_path):
    d = spark.createDataFrame([(1, "a,b"), (2, None)], "id int, t string")
    sinks.write_csv(d, f"{tmp_path}/csv", ["t", "id"])
    assert sorted(line for p in (tmp_path / "csv").glob("part*") for line in p.read_text().splitlines() if line != "t,id") == ['"a,b",1', ",2"]
    sinks.write_state(d, f"{tmp_path}/state")
    sinks.write_state(d.limit(1), f"{tmp_path}/state")
    assert spark.read.parquet(f"{tmp_path}/state").count() == 1
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": 2}]')
    assert sorted(r["id"] for r in json_docs.read_arrays(spark, f"{tmp_path}/a.json", "id int").collect()) == [1, 2]
    e = d.select(F.array_join(rules.all_matches(F.coalesce("t", F.lit("")), [("x", "b"), ("c", "a"), ("n", "z")]), ",").alias("m"))
    assert sorted(r["m"] for r in e.collect()) == ["", "c,x"]
