"""Token counts: an exact histogram of encoded lengths.

Documents are counted by encoded length, which is all that totals need.  Suffix sums over the lengths
give, for any context limit L, the tokens of texts cut at L: the tokens of the texts shorter than L and
L for each of the others.

Defined results: null and empty texts have length 0; very long texts are encoded whole and have a length of
their own; repeated rows and rows of equal length are counted each; an empty table gives an empty histogram;
doc_id, null or not, and other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import steps
from .shared import cut
from .token_files import encoder

#: Lengths that share a partition of the suffix sums.
SPAN = 256


def lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """length of every document."""

    def run(batches):
        encode = encoder(tokenizer).texts
        for batch in batches:
            for part in steps(batch, 0):
                yield pa.RecordBatch.from_arrays([pa.array([len(x) // 4 for x in encode(part.column(0).to_pylist())], pa.int64())], ["length"])

    return docs.select("text").mapInArrow(run, "length long")


def histogram(lengths: DataFrame) -> DataFrame:
    """For each length: docs, tokens; docs and tokens of that length or more; tokens when texts are cut there;
    and the share of documents that are not longer."""
    # cut: both the sums over spans and those inside use it, and texts are encoded once
    rows = cut(lengths.groupBy("length").agg(F.count("*").alias("docs")).withColumn("tokens", F.col("length") * F.col("docs")))
    rows = rows.withColumn("_span", F.floor(F.col("length") / SPAN))
    spans = rows.groupBy("_span").agg(F.sum("docs").alias("_d"), F.sum("tokens").alias("_t"))
    after = Window.orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)  # one row a span of lengths
    whole = Window.orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spans = spans.select(
        "_span",
        *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in ("_d", "_t")),
        *(F.sum(c).over(whole).alias(f"{c}_all") for c in ("_d", "_t")),
    )
    inside = Window.partitionBy("_span").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    at_least = rows.join(spans, "_span").select(
        "length", "docs", "tokens", "_d_all", "_t_all",
        (F.sum("docs").over(inside) + F.col("_d_after")).alias("docs_at_least"),
        (F.sum("tokens").over(inside) + F.col("_t_after")).alias("tokens_at_least"),
    )
    return at_least.select(
        "length", "docs", "tokens", "docs_at_least", "tokens_at_least",
        (F.col("_t_all") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
        ((F.col("_d_all") - F.col("docs_at_least") + F.col("docs")) / F.col("_d_all")).alias("share_not_longer"),
    )


def truncated_total(hist: DataFrame, limit: int) -> int:
    """Tokens of all texts cut at ``limit``, for any limit, from the first length above it."""
    above = hist.where(F.col("length") >= limit).orderBy("length").first()
    if above:
        return above["truncated_tokens"] - (above["length"] - limit) * above["docs_at_least"]
    return hist.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]


def quantile(hist: DataFrame, q: float) -> int | None:
    """The smallest length that at least ``q`` of the documents do not exceed."""
    return hist.where(F.col("share_not_longer") >= q - 1e-12).agg(F.min("length")).first()[0]
