"""As-of lookups, rollups, retention and state over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: str, ts: str, value: str, right_when: Column | None = None) -> DataFrame:
    """``left`` with the ``value`` of the latest right row strictly before it, within ``by``.

    Both sides meet in one sorted window, so nothing is matched pairwise.  ``value`` must be unique in time
    order: ties at one time are settled by the larger value.
    """
    r = right.where(right_when) if right_when is not None else right
    both = left.select(by, ts, F.struct(*left.columns).alias("__l"), F.lit(None).cast(r.schema[value].dataType).alias("__v"), F.lit(0).alias("__side"))
    both = both.unionByName(r.select(by, ts, F.lit(None).cast(both.schema["__l"].dataType).alias("__l"), F.col(value).alias("__v"), F.lit(1).alias("__side")))
    seen = Window.partitionBy(by).orderBy(ts, "__side", "__v").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("__found", F.last("__v", ignorenulls=True).over(seen)).where("__side = 0").select("__l.*", F.col("__found").alias(f"prior_{value}"))


def latest_with_all(rows: DataFrame, run: str, kind: str, needed: list[str], ts: str) -> DataFrame:
    """The latest run that has every kind of ``needed``."""
    has = [F.bool_or(F.col(kind) == k) for k in needed]
    good = has[0]
    for h in has[1:]:
        good = good & h
    runs = rows.groupBy(run).agg(good.alias("__ok"), F.max(ts).alias(ts)).where("__ok")
    return runs.agg(F.max(F.struct(ts, run)).alias("m")).select(F.col(f"m.{run}").alias(run), F.col(f"m.{ts}").alias(ts))


def first_found(rows: DataFrame, key: str, lookups: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """key, value, found_by: the first of several lookups (name, rows, column) that has a value, in their order."""
    out, names = rows.select(key), []
    for name, found, column in lookups:
        out = out.join(found.select(key, F.col(column).alias(f"__{name}")), key, "left")
        names.append(name)
    value = F.coalesce(*[F.col(f"__{n}") for n in names])
    by = F.coalesce(*[F.when(F.col(f"__{n}").isNotNull(), F.lit(n)) for n in names])
    return out.select(key, value.alias("value"), F.coalesce(by, F.lit("none")).alias("found_by"))


def last_n(rows: DataFrame, key: str | None, order: list[Column], n: int) -> DataFrame:
    """The ``n`` first rows by ``order`` of each key, with their number ``nth``."""
    window = Window.partitionBy(key) if key else Window.partitionBy()
    return rows.withColumn("nth", F.row_number().over(window.orderBy(*order))).where(F.col("nth") <= n)


def prune_plan(runs: DataFrame, key: str, ts: str, run: str, keep: int, now: Column, days: int) -> DataFrame:
    """All runs with ``prune``: beyond the newest ``keep`` of their key or older than ``days``; the newest stays."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), F.desc(run)))
    old = F.col(ts) < now - F.expr(f"INTERVAL {days} DAYS")
    return runs.withColumn("nth", nth).withColumn("prune", (F.col("nth") > 1) & ((F.col("nth") > keep) | old))


def rolling(days: DataFrame, key: str, day: str, value: str, n: int = 7) -> DataFrame:
    """key, total and the ascending series of the last ``n`` days."""
    kept = last_n(days, key, [F.desc(day)], n)
    return kept.groupBy(key).agg(
        F.count("*").alias("days"), F.sum(value).alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(day).alias("d"), F.col(value).alias("v")))), lambda x: x["v"].cast("string")), ",").alias("series")
    )


def merge_identities(rows: DataFrame, key: str, sets: list[str], firsts: list[str], order: str) -> DataFrame:
    """One row a key: the sorted union of each of ``sets``, the first filled value of each of ``firsts``."""
    unions = [F.array_join(F.sort_array(F.collect_set(c)), ",").alias(c) for c in sets]
    first = [F.min_by(F.col(c), F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(order))).alias(c) for c in firsts]
    return rows.groupBy(key).agg(*unions, *first)


def failure_islands(rows: DataFrame, key: str, order: list[str], failed: Column, least: int, first: str | None = None) -> DataFrame:
    """key, island, length, first: runs of ``least`` or more consecutive failures, as a breaker would open on.

    ``first`` is the least of that column in the run; the first of ``order`` where it is left out.
    """
    by = Window.partitionBy(key).orderBy(*order)
    island = F.sum((~failed).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumns({"__island": island, "__failed": failed}).where("__failed")
    out = marked.groupBy(key, F.col("__island").cast("long").alias("island")).agg(F.count("*").alias("length"), F.min(first or order[0]).alias("first"))
    return out.where(F.col("length") >= least)


def cached(rows: DataFrame, cache: DataFrame, key: str, valid: Column, value: str, make: Column) -> DataFrame:
    """``rows`` with ``value`` from valid cache entries, and computed by ``make`` elsewhere; ``hit`` tells which."""
    found = rows.join(cache.where(valid).select(key, F.col(value).alias("__cached")), key, "left")
    hit = F.col("__cached").isNotNull()
    return found.withColumn("hit", hit).withColumn(value, F.when(hit, F.col("__cached")).otherwise(make)).drop("__cached")
