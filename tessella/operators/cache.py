"""A versioned cache: what is missing or outdated is computed, once a key, and merged back.

The cache is a folder of generations (Parquet) and a pointer to the current one, which moves only after a generation is
complete, so that a failed run leaves the cache as it was.  A run that computes nothing writes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import working_folder
from ..sources.publishing import fs, put_small, store_of

_CURRENT = "current.json"


def current(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """The cache's rows (key, version, value ..) and the number of its generation; none and 0 where there is no cache."""
    store, root = store_of(path)
    if store.get_file_info(f"{root}/{_CURRENT}").type == fs.FileType.NotFound:
        return None, 0
    with store.open_input_stream(f"{root}/{_CURRENT}") as f:
        number = json.loads(f.read())["generation"]
    return spark.read.parquet(f"{path.rstrip('/')}/generation={number}"), number


def refreshed(
    rows: DataFrame, path: str, key: str, value: str, version: int, make: Callable[[DataFrame], Column], fallback: Column | None = None, keep: int = 2
) -> tuple[DataFrame, dict[str, int]]:
    """``rows`` with ``value`` from the cache at ``path``, which first gets what it lacks; and counters of distinct keys.

    A key is a hit if its entry has this version or a later one and a value that is not null; otherwise it is missing or outdated.
    ``make`` gets one row for each of those keys (any of its rows, and ``old_<value>``, the outdated value or null) and
    gives the value; where that is null, ``fallback`` (over the same row) backfills it.  An entry whose value stays null is
    written, so that it is seen as tried, but tried again in the next run.  Of a key's entries the highest version
    that has a value counts.  Rows
    with a null key get a null value.  The last ``keep`` generations stay, for readers that have begun.
    """
    spark, old = rows.sparkSession, f"old_{value}"
    known, number = current(spark, path)
    wanted = rows.where(F.col(key).isNotNull())
    one = wanted.groupBy(F.col(key).alias("__k")).agg(F.min(F.struct(*[F.col(c) for c in wanted.columns])).alias("__r"))
    one = one.select("__k", *[F.col(f"__r.{c}").alias(c) for c in wanted.columns if c != value])
    if known is None:
        joined = one.withColumns({"__v": F.lit(None).cast("int"), "__old": F.lit(None)})
    else:
        joined = one.join(known.select(F.col("key").alias("__c"), F.col("version").alias("__v"), F.col("value").alias("__old")), F.col("__k") == F.col("__c"), "left").drop("__c")
    state = F.when(F.col("__v").isNull(), "missing").when((F.col("__v") >= version) & F.col("__old").isNotNull(), "hit").otherwise("outdated")
    kept = working_folder(spark, "cache-state")
    seen = Observation()
    counted = joined.withColumn("__state", state).observe(seen, *[F.count_if(F.col("__state") == s).alias(s) for s in ("hit", "missing", "outdated")])
    todo = counted.where("__state <> 'hit'").withColumnRenamed("__old", old)
    made = make(todo)
    made = F.coalesce(made, fallback) if fallback is not None else made
    todo.select(F.col("__k").alias("key"), F.lit(version).alias("version"), made.alias("value")).write.parquet(kept)
    counters = {k: int(v or 0) for k, v in seen.get.items()}
    fresh = spark.read.parquet(kept)
    counters["written"] = counters["missing"] + counters["outdated"]
    if counters["written"]:
        merged = fresh
        if known is not None:
            both = known.select("key", "version", "value").unionByName(fresh)
            best = F.max_by(F.struct("version", "value"), F.struct(F.col("value").isNotNull(), "version"))
            merged = both.groupBy("key").agg(best.alias("b")).select("key", "b.version", "b.value")
        merged.write.parquet(f"{path.rstrip('/')}/generation={number + 1}")
        store, root = store_of(path)
        put_small(store, f"{root}/{_CURRENT}", {"generation": number + 1})
        gone = f"{root}/generation={number + 1 - keep}"
        if number + 1 - keep > 0 and store.get_file_info(gone).type == fs.FileType.Directory:
            store.delete_dir(gone)
        known, _ = current(spark, path)
    if known is None:
        return rows.withColumn(value, F.lit(None).cast(fresh.schema["value"].dataType)), counters
    found = known.select(F.col("key").alias("__c"), F.col("value").alias("__found"))
    out = rows.join(found, F.col(key) == F.col("__c"), "left").withColumn(value, F.col("__found")).drop("__c", "__found")
    return out, counters
