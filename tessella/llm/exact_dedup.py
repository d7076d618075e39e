"""Exact deduplication: a tree-merge of digest runs.

Every input partition makes one run: its texts' digests, each with the identifier that stays and a
count.  In every round ``fan_in`` neighbouring runs meet (run numbers lose ``log2(fan_in)`` bits) and
are merged on the digest by a sort-based aggregate, so a digest has at most one entry a run, however
many copies the text has, and only digests travel.  A digest entry is the SHA-256 together with the
byte length and an independent 64-bit hash; entries merge only where all three agree, at every level.

Defined results: a null text counts as empty; very long texts are digested whole; a null ``doc_id`` is smaller than any other; of rows with
equal text *and* ``doc_id`` one row stays, an arbitrary one where they differ in other columns; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import columns, cut, rounds

FAN_IN = 8
_KEY = ["_sha", "_bytes", "_check"]


def _digest(text: Column) -> list[Column]:
    whole = F.coalesce(text, F.lit(""))
    return [
        F.unhex(F.sha2(whole, 256)).alias("_sha"),
        F.octet_length(whole).alias("_bytes"),
        F.xxhash64(whole).alias("_check"),
    ]


def _best(largest: bool):
    return F.max if largest else F.min


def merge_runs(leaves: DataFrame, n_runs: int, largest: bool = True, fan_in: int = FAN_IN) -> DataFrame:
    """``leaves(_run, digest key, _keep, _n)`` merged round by round into one run."""
    runs = leaves
    for _ in range(rounds(n_runs, fan_in)):
        runs = runs.withColumn("_run", F.floor(F.col("_run") / fan_in).cast("int"))
        runs = runs.groupBy("_run", *_KEY).agg(_best(largest)("_keep").alias("_keep"), F.sum("_n").alias("_n"))
    return runs.drop("_run")


def exact_groups(docs: DataFrame, largest: bool = True, fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    base = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            *_digest(F.col("text")),
            F.spark_partition_id().alias("_run"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    keep = F.struct(F.col("doc_id"), F.col("_row"))
    leaves = base.select("_run", *_KEY, keep.alias("_keep"), F.lit(1).cast("long").alias("_n"))
    merged = merge_runs(leaves, base.rdd.getNumPartitions(), largest, fan_in)
    return base.join(merged, _KEY).select(
        "doc_id",
        F.col("_keep.doc_id").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_row") == F.col("_keep._row")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, largest: bool = True, fan_in: int = FAN_IN) -> DataFrame:
    """``docs`` with one row for each different text; all columns are kept, whatever their names.

    Texts are shuffled once: rows meet the digests that stay and then each other by the same keys.
    """
    key = ["_sha", "_id", "_unnamed"]
    known = lambda c: [F.coalesce(c, F.lit(0)).alias("_id"), c.isNull().alias("_unnamed")]
    kept = exact_groups(docs, largest, fan_in).where("kept").select(F.unhex("text_sha256").alias("_sha"), *known(F.col("doc_id")))
    whole = F.struct(*columns(docs)).alias("_row")  # the columns' names cannot clash inside
    own = docs.select(whole, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("_sha"), *known(F.col("doc_id").cast("long")))
    return own.join(kept, key, "left_semi").dropDuplicates(key).select("_row.*")
