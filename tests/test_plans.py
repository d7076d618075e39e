"""Composites: augmented records, sidecars, period insights, input selection, careful scores."""

import os

from pyspark.sql import functions as F

from tessella.functions import rules
from tessella.interfaces import FolderCache, TextHashBackend
from tessella.plans import augment, insights, semantic
from tessella.sources import selection


class Echo:
    name = "echo"

    def __init__(self, tag):
        self.tag = tag

    def answers(self, texts):
        return [None if "?" in t else f'{{"title": "{t}", "tags": ["{self.tag}"]}}' for t in texts]


def test_answers_are_cached_backfilled_and_upgraded(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b?"), (4, None)], "id int, t string")
    ruled = F.lit('{"title": "rule", "tags": "r, s"}')
    run = lambda rows, tag, version: augment.augmented(rows, Echo(tag), FolderCache(f"{tmp_path}/c"), "t", version, ruled, ["title"], {}, ["tags"])
    out, seen = run(d, "x", 1)
    got = {r["id"]: (r["payload"]["title"], r["payload"]["tags"]) for r in out.collect()}
    assert got == {1: ("a", ["x"]), 2: ("a", ["x"]), 3: ("rule", ["r", "s"]), 4: (None, ["x"])} and seen["written"] == 3
    out, seen = run(d.where("id < 4"), "y", 2)
    got = {r["id"]: r["payload"]["tags"] for r in out.collect()}
    assert got == {1: ["x", "y"], 2: ["x", "y"], 3: ["r", "s"]} and seen == {"hit": 0, "missing": 0, "outdated": 2, "written": 2}
    assert run(d, "z", 1)[1] == {"hit": 3, "missing": 0, "outdated": 0, "written": 0}
    assert [r[0] for r in d.select(augment.match_score(["x"], ["y"], F.array(F.lit("y")))).distinct().collect()] == [33]


def test_sidecars_share_a_cache_and_do_not_rank(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, t string")
    cached = FolderCache(f"{tmp_path}/v")
    one = semantic.sidecar(d, "id", "t", [F.desc("id")], 2, TextHashBackend(), cached)
    two = semantic.sidecar(d, "id", "t", [F.asc("id")], 9, TextHashBackend(), cached)
    rows, counters = semantic.merged([("p", *one), ("q", *two)], spark)
    assert sorted((r["profile"], r["id"]) for r in rows.collect()) == [("p", 2), ("p", 3), ("q", 1), ("q", 2), ("q", 3)]
    assert {(r["profile"], r["counter"]): r["n"] for r in counters.collect()}[("all", "written")] == 2
    assert len({tuple(r["vector"]) for r in rows.collect()}) == 2


def test_insights_of_an_empty_period(spark, tmp_path):
    after = spark.createDataFrame([(1, "x", 3, "f"), (2, "y", 4, None)], "id int, s string, n int, g string")
    got = {(r["section"], r["name"]): r["value"] for r in insights.period(after.limit(0), after, "id", ["s"], "n", "g", [4]).collect()}
    assert got[("change", "new")] == 2 and got[("top_new", "2")] == 4 and got[("bucket", "..4")] == got[("bucket", "4..")] == 1
    assert got[("median", "before")] is None and got[("median", "after")] == 3.5 and got[("trend", "median")] is None and got[("family", None)] == 1
    calls = []
    make = lambda: calls.append(1) or after
    assert [insights.reused(spark, f"{tmp_path}/i", {"v": v}, make)[1] for v in (1, 1.0, 2, 1)] == [False, True, False, False] and len(calls) == 3


def test_selection_explains_every_candidate(spark, tmp_path):
    paths = [(n, str(tmp_path / n)) for n in ("fine", "mid", "raw")]
    for name, age in (("fine", 1), ("raw", 2)):
        spark.range(1).write.parquet(str(tmp_path / name))
        for p in (tmp_path / name).glob("*"):
            os.utime(p, (1_000_000 * age, 1_000_000 * age))
    (tmp_path / "mid").mkdir()
    (tmp_path / "mid" / "part-0.parquet").write_text("a job that was not committed")
    assert selection.chosen(paths)[0] == "raw" and selection.chosen(paths, fresh=False)[0] == "fine" and selection.chosen(paths, only="fine")[0] == "fine"
    best, rows = selection.chosen(paths, off={"raw"})
    assert best == "fine" and [r[3] for r in rows] == ["chosen", "missing", "off"] and selection.explained(spark, rows).count() == 3
    assert selection.chosen(paths[1:2]) == (None, [("mid", paths[1][1], False, "missing")])


def test_short_texts_lose_less_and_pins_hold(spark):
    model = rules.ScoreModel((rules.Rule("bad", ("bad",), -4),), floor_words=10, damped=(20, 50), pins=(("k", "good", 7),))
    d = spark.createDataFrame([("bad " * 1 + "ok " * 9, "x"), ("bad " * 3 + "ok " * 27, "x"), ("bad " * 10, "good"), (None, None)], "t string, k string").withColumn("title", F.lit(""))
    got = [(r["raw_score"], r["adjusted_score"], r["final_score"]) for r in rules.score(d, model, "title", "t").collect()]
    assert got == [(-120, -120, 0), (-240, -240, 0), (-120, 7, 7), (0, 0, 0)]
