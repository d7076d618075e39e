"""Keyed state over streams that stop and start again."""

import datetime

from pyspark.sql import functions as F

from tessella.streaming import keyed_state


def at(minute):
    return datetime.datetime(2024, 1, 1, 0, 0, tzinfo=datetime.timezone.utc) + datetime.timedelta(minutes=minute)


def test_state_survives_restarts_and_forgets_by_timer(spark, tmp_path):
    schema = "k string, ts timestamp, s int, c string, other string"
    batches = [
        [("a", at(0), 1, "x", ""), ("a", at(5), 3, "x", ""), ("b", at(1), 1, None, ""), (None, at(2), 7, "n", "")],
        [("a", at(6), 9, "y", ""), ("a", at(6), 2, "x", ""), ("c", at(40), 1, "x", "")],
        [("b", at(41), 50, "z", ""), ("a", at(100), 9, "y", "")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        found = keyed_state.last_seen(stream, "k", "ts", "s", "c", 5, gone_ms=30 * 60_000)
        keyed_state.append(found, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    got = sorted(((r["k"], r["kind"], r["at"].minute + 60 * r["at"].hour, r["score_delta"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=repr)
    expected = [
        ("a", "new", 5, None), ("a", "score", 6, 6), ("a", "content", 6, None), ("b", "new", 1, None), (None, "new", 2, None), ("c", "new", 40, None),
        ("a", "gone", 6, None), ("b", "gone", 1, None), (None, "gone", 2, None), ("b", "new", 41, None), ("a", "new", 100, None), ("c", "gone", 40, None), ("b", "gone", 41, None),
    ]
    assert got == sorted(expected, key=repr)


def test_ranks_move_against_the_runs_before(spark, tmp_path):
    runs = [[("a", 1, 1), ("b", 1, 2)], [("b", 2, 1), ("c", 2, 2)], [("a", 2, 9), ("c", 3, 1), ("a", 3, 2)]]
    for rows in runs:
        spark.createDataFrame(rows, "k string, run int, rank int").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("k string, run int, rank int").parquet(f"{tmp_path}/in")
        keyed_state.append(keyed_state.rank_moves(stream, "k", "run", "rank"), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("k", "run", "rank", F.coalesce("previous_rank", F.lit(0)), F.coalesce("move", F.lit(0))).collect())
    assert got == [("a", 1, 1, 0, 0), ("a", 2, 9, 1, -8), ("a", 3, 2, 9, 7), ("b", 1, 2, 0, 0), ("b", 2, 1, 2, 1), ("c", 2, 2, 0, 0), ("c", 3, 1, 2, 1)]


def test_a_hot_key_is_thinned_before_the_shuffle(spark):
    rows = spark.range(50_000).select(F.lit("hot").alias("k"), (F.col("id") % 977).alias("o"), F.col("id"))
    left = keyed_state.thinned(rows, "k", ["o", "id"]).collect()
    assert len(left) < 50 and max((r["o"], r["id"]) for r in left) == max((i % 977, i) for i in range(50_000))


def test_the_store_setting_is_put_back(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    with keyed_state.keyed_store(spark):
        assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
