"""Filters, some of which depend on the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import positions


def keep_with_fallback(rows: DataFrame, keep: Column, signal: Column) -> DataFrame:
    """Rows where ``keep`` holds; all rows if none does or if no row has a ``signal``.

    One plan: the two global facts are a one-row aggregate that every partition gets, not a driver branch.
    """
    facts = rows.agg(F.coalesce(F.bool_or(keep), F.lit(False)).alias("__any_kept"), F.coalesce(F.bool_or(signal), F.lit(False)).alias("__any_signal"))
    joined = rows.join(F.broadcast(facts))  # one row
    return joined.where(keep | ~F.col("__any_kept") | ~F.col("__any_signal")).drop("__any_kept", "__any_signal")


def shortlist(rows: DataFrame, state: DataFrame, key: str, least: int, score: str = "score", status: str = "status") -> DataFrame:
    """Rows that score ``least`` and are neither unavailable nor ignored in ``state(key, user_status)``.

    ``rank`` puts deprioritised rows last, else it goes by falling score and the key.
    """
    joined = rows.join(state.select(key, "user_status"), key, "left")
    user = F.coalesce("user_status", F.lit(""))
    kept = joined.where((F.col(score) >= least) & (F.coalesce(F.col(status), F.lit("")) != "unavailable") & (user != "ignored"))
    kept = kept.withColumn("later", (user == "deprioritized").cast("int"))
    return positions(kept, [], [F.asc("later"), F.desc(score), F.asc(key)], "rank").withColumn("rank", F.col("rank") + 1)


def suppress(changes: DataFrame, state: DataFrame, key: str, block_new: list[str], block_other: list[str]) -> DataFrame:
    """``changes(key, kind, ..)`` without the new ones, and the others, whose user status blocks them."""
    blocked_new = state.where(F.col("user_status").isin(block_new)).select(key)
    blocked_other = state.where(F.col("user_status").isin(block_other)).select(key)
    new = changes.where("kind = 'new'").join(blocked_new, key, "left_anti")
    return new.unionByName(changes.where("kind <> 'new'").join(blocked_other, key, "left_anti"))


def drop_ephemeral(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.drop(*names)
