"""What a period's report is made from, as one long frame, and its reuse while its inputs are the same."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff, history
from ..operators.ranking import top
from ..sources.publishing import fs, put_small, store_of
from ..sources.replay import signature


def period(before: DataFrame, after: DataFrame, key: str, fields: list[str], score: str, family: str, bounds: list[int], k: int = 5) -> DataFrame:
    """(section, name, value) of two snapshots of a period, each an aggregate or a bounded top-k.

    ``change``: rows by kind.  ``top_new`` and ``top_changed``: the ``k`` highest of each, with their scores.  ``family``: the ``k`` largest
    families of the later snapshot.  ``bucket``: its scores by exclusive buckets below, between and from ``bounds``.
    ``median`` of either, interpolated, and ``trend``, their difference at three places, half to even (null if either is empty).
    """
    as_rows = lambda rows, section, name, value: rows.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.col(value).cast("double").alias("value"))
    d = diff.diff(before, after, key, fields)
    out = as_rows(d.groupBy("kind").agg(F.count("*").alias("n")), "change", "kind", "n")
    scored = d.join(after.select(key, F.col(score).alias("s")), key)
    for kind in ("new", "changed"):
        first = top(scored.where(F.col("kind") == kind).select(key, "s"), [F.desc("s"), F.asc(key)], k)
        out = out.unionByName(as_rows(first, f"top_{kind}", key, "s"))
    families = top(after.groupBy(family).agg(F.count("*").alias("n")), [F.desc("n"), F.lower(family), F.asc(family)], k)
    out = out.unionByName(as_rows(families, "family", family, "n"))
    edges = [None, *bounds, None]
    inside = lambda low, high: (F.lit(True) if low is None else F.col(score) >= low) & (F.lit(True) if high is None else F.col(score) < high)
    names = [f"{'' if a is None else a}..{'' if b is None else b}" for a, b in zip(edges, edges[1:])]
    buckets = after.agg(*[F.count_if(inside(a, b)).alias(n) for n, a, b in zip(names, edges, edges[1:])])
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    out = out.unionByName(as_rows(buckets.selectExpr(f"stack({len(names)}, {pairs}) AS (name, n)"), "bucket", "name", "n"))
    medians = before.agg(F.median(score).alias("before")).join(F.broadcast(after.agg(F.median(score).alias("after"))))  # a row each
    medians = medians.withColumn("trend", F.bround(F.col("after") - F.col("before"), 3))
    stacked = medians.selectExpr("stack(3, 'median', 'before', before, 'median', 'after', after, 'trend', 'median', trend) AS (section, name, value)")
    return out.unionByName(stacked)


def rolling_sections(days: DataFrame, key: str, day: str, value: str, n: int = 7) -> DataFrame:
    """(section, name, value): totals of each key's last ``n`` days."""
    r = history.rolling(days, key, day, value, n)
    return r.select(F.lit("rolling").alias("section"), F.col(key).cast("string").alias("name"), F.col("total").cast("double").alias("value"))


def reused(spark: SparkSession, path: str, metadata: dict, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """What ``make`` gives, from ``path`` if it was made there with equal ``metadata``; and whether it was reused.

    ``metadata`` should hold all that the result depends on, such as fingerprints of inputs and versions.  Its record is written
    after the rows, so a run that failed between is not reused.
    """
    store, root = store_of(path)
    wanted = signature(metadata)
    if store.get_file_info(f"{root}/made.json").type != fs.FileType.NotFound:
        with store.open_input_stream(f"{root}/made.json") as f:
            if json.loads(f.read())["metadata"] == wanted:
                return spark.read.parquet(f"{path.rstrip('/')}/{wanted}"), True
    make().write.mode("overwrite").parquet(f"{path.rstrip('/')}/{wanted}")
    put_small(store, f"{root}/made.json", {"metadata": wanted})
    return spark.read.parquet(f"{path.rstrip('/')}/{wanted}"), False
