"""Bounded semantic re-ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import clamp
from ..functions.vectors import bag, bag_cosine, boost
from ..interfaces import EmbeddingBackend, ValueCache, content_key
from ..operators.ranking import capped, top
from ..session import working_folder


def boosted(rows: DataFrame, key: str, score: str, text: str, profile: str, k: int, threshold: float, most: float, texts: DataFrame | None = None) -> DataFrame:
    """key, evaluated, reason, base_score, similarity, boost, boosted_score: evidence for every row.

    Scores are kept without texts; a distributed top-k of them picks the rows that are embedded, and only their texts are
    fetched, from ``texts`` (key and text; ``rows`` where it is left out).  ``k`` bounds them, so they may be broadcast to the
    rest.  Rows beyond it keep their score and have no similarity.
    """
    spark = rows.sparkSession
    path = working_folder(spark, "scores")
    rows.select(key, score).write.parquet(path)
    scores = spark.read.parquet(path)
    chosen = top(scores, [F.desc(score), F.asc(key)], k).select(F.col(key).alias("__k"))
    first = (rows if texts is None else texts).select(key, text).join(F.broadcast(chosen), F.col(key) == F.col("__k"), "left_semi")
    wanted = bag(spark.createDataFrame([(0, profile)], "p int, t string"), "p", "t").select("slot", F.col("n").alias("m"))
    measured = bag_cosine(bag(first, key, text, every=True), wanted, key)
    measured = measured.select(F.col(key).alias("__k"), F.round("similarity", 6).alias("similarity"))
    joined = scores.join(F.broadcast(measured), F.col(key) == F.col("__k"), "left")
    seen = F.col("__k").isNotNull()
    lift = F.coalesce(boost(F.col("similarity"), threshold, most), F.lit(0.0))
    reason = F.when(~seen, "beyond_top").when(lift > 0, "boosted").otherwise("below_threshold")
    boosted_score = clamp(F.bround(F.col(score) + lift, 0))
    return joined.select(key, seen.alias("evaluated"), reason.alias("reason"), F.col(score).alias("base_score"), "similarity", F.round(lift, 6).alias("boost"), boosted_score.alias("boosted_score"))


def sidecar(rows: DataFrame, key: str, text: str, order: list, most: int, backend: EmbeddingBackend, cached: ValueCache) -> tuple[DataFrame, dict[str, int]]:
    """(key, vector) of the first ``most`` rows in ``order``, and the cache's counters; nothing is ranked anew."""
    chosen = capped(rows, order, most).select(key, text).withColumn("_content", content_key(backend, F.col(text)))
    out, counters = cached.refresh(chosen, "_content", "vector", backend.version, lambda _: backend.embed(F.col(text)))
    return out.select(key, "vector"), counters | {"rows": out.count()}


def merged(artifacts: list[tuple[str, DataFrame, dict[str, int]]], spark) -> tuple[DataFrame, DataFrame]:
    """Artifacts of several profiles as one, with their ``profile``, and a row of counters for each profile and one for all."""
    rows, counts, total = None, [], {}
    for profile, found, counters in artifacts:
        one = found.select(F.lit(profile).alias("profile"), "*")
        rows = one if rows is None else rows.unionByName(one)
        counts += [(profile, k, v) for k, v in sorted(counters.items())]
        total = {k: total.get(k, 0) + v for k, v in counters.items()}
    counts += [("all", k, v) for k, v in sorted(total.items())]
    return rows, spark.createDataFrame(counts, "profile string, counter string, n long")
