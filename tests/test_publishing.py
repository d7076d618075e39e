"""Publishing, observed writes, the registry, providers as tables and streams."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessella.sources import publishing, snapshots


def test_a_failed_run_leaves_the_latest_one(spark, tmp_path):
    base = str(tmp_path)
    assert publishing.latest_run(spark, base) is None
    d = spark.range(100).repartition(4).withColumn("x", F.when(F.col("id") > 3, F.col("id").cast("string")))
    publishing.publish(d, base, "r1")
    before = (tmp_path / "latest.json").read_text()
    with pytest.raises(PySparkException):
        publishing.publish(d.withColumn("x", F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("x"))), base, "r2")
    assert (tmp_path / "latest.json").read_text() == before and not (tmp_path / "runs" / "r2" / "manifest.json").exists()
    assert sorted(map(tuple, publishing.published(spark, base).collect())) == sorted(map(tuple, d.collect()))
    publishing.publish(d.limit(0), base, "r2")
    assert publishing.latest_run(spark, base) == "r2" and publishing.published(spark, base, "r1").count() == 100
    with pytest.raises(PySparkException, match="published already"):
        publishing.publish(d, base, "r1")
    with pytest.raises(PySparkException, match="not a name"):
        publishing.publish(d, base, "../r1")
    # an orphan of a lost attempt is no part of the run
    parts = sorted((tmp_path / "runs" / "r1").glob("part-*"))
    (tmp_path / "runs" / "r1" / "part-orphan.parquet").write_bytes(parts[0].read_bytes())
    assert publishing.published(spark, base, "r1").count() == 100 and publishing.damaged(spark, base, "r1").count() == 0
    parts[0].write_bytes(b"x")
    parts[1].unlink()
    assert sorted(map(tuple, publishing.damaged(spark, base, "r1").collect())) == [(parts[0].name, "changed"), (parts[1].name, "missing")]


def test_observed_counts_are_those_of_the_rows(spark, tmp_path):
    d = spark.range(1000).withColumn("v", F.when(F.col("id") % 3 > 0, F.col("id")))
    got = publishing.write_observed(d, f"{tmp_path}/o", {"rows": F.count("*"), "filled": F.count("v"), "most": F.max("v")})
    assert got == {"rows": 1000, "filled": 666, "most": 998}
    empty = publishing.write_observed(d.limit(0), f"{tmp_path}/e", {"rows": F.count("*"), "most": F.max("v")})
    h = publishing.health(spark, [("o", got), ("e", empty)], [("o", "rows", "least", 1), ("e", "most", "least", 1), ("e", "rows", "most", 5), ("gone", "rows", "least", 1)])
    assert {(r["stage"], r["metric"]): r["problem"] for r in h.collect()} == {
        ("o", "rows"): None, ("o", "filled"): None, ("o", "most"): None, ("e", "rows"): None, ("e", "most"): "not observed", ("gone", "rows"): "not observed",
    }
    assert {r["stage"]: r["status"] for r in publishing.summary(h).collect()} == {"o": "ok", "e": "failed", "gone": "failed"}


def test_resolve_prefers_a_pointer_that_is_there(spark):
    index = spark.createDataFrame([("a", "r1", True, 1), ("a", "r2", False, 2), ("b", "r1", True, 1), ("b", "r2", True, 1), ("c", "r1", False, 1)], "owner string, run string, complete boolean, at int")
    pointers = spark.createDataFrame([("a", "r2"), ("b", "r9"), ("z", "r1")], "owner string, run string")
    assert sorted(map(tuple, publishing.resolve(index, pointers).collect())) == [("a", "r2", "pointer"), ("b", "r2", "complete"), ("c", None, "none")]


def test_filters_prune_providers(spark, tmp_path):
    for k in range(5):
        folder = tmp_path / f"p{k}"
        folder.mkdir()
        (folder / "0.json").write_text("\n".join(json.dumps({"id": i}) for i in range(k)) + "\n[1]\n")
    config = snapshots.load_config(json.dumps([{"id": f"p{k}", "folder": str(tmp_path / f"p{k}")} for k in range(5)]))
    snapshots.register(spark, snapshots.configured(config))
    rows = spark.read.format("provider").load()
    assert rows.rdd.getNumPartitions() == 5 and rows.count() == 10
    two = rows.where("provider IN ('p2', 'p4') AND _ord > 0")
    assert two.rdd.getNumPartitions() == 2 and two.count() == 4
    assert rows.where("provider = 'p9'").count() == 0


def test_provider_configuration():
    good = [{"id": "b", "folder": "/b", "enabled": False}, {"id": "a", "folder": "/a"}]
    config = snapshots.load_config(json.dumps(good))
    assert [p["id"] for p in config] == ["a", "b"] and list(snapshots.configured(config)) == ["a"]
    with pytest.raises(ValueError, match="disabled providers: b"):
        snapshots.configured(config, "a, b")
    with pytest.raises(ValueError, match="unknown providers: c"):
        snapshots.configured(config, "c")
    for bad in ([{"id": "a"}], [{"id": "a", "folder": 1}], [{"id": "a", "folder": "", "x": 1}], [good[0], good[0]], {"id": "a"}):
        with pytest.raises(ValueError):
            snapshots.load_config(json.dumps(bad))
