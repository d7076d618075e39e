"""Differences of two snapshots."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_a_key(rows: DataFrame, key: str | list[str], order: str, last: bool = True) -> DataFrame:
    """The last (or first) row by ``order`` of each key, of one column or several; an aggregate that combines before the shuffle."""
    pick = F.max_by if last else F.min_by
    keys = [key] if isinstance(key, str) else key
    found = rows.groupBy(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]).agg(pick(F.struct(*rows.columns), F.col(order)).alias("__row"))
    return found.select(*[F.col(f"__row.{c}").alias(c) for c in rows.columns])


def diff(before: DataFrame, after: DataFrame, key: str, fields: list[str], clean=lambda c: c, gate: str | None = None) -> DataFrame:
    """key, kind (new, removed, changed, same) and changed_fields (sorted).

    Fields are compared after ``clean``, null-safe.  With ``gate`` a row counts as changed only where that
    column differs, whatever the fields say.  Keys must be unique on each side.
    """
    columns = fields + ([gate] if gate and gate not in fields else [])
    a = before.select(F.col(key).alias("__ka"), *[clean(F.col(f)).alias(f"__a_{f}") for f in columns])
    b = after.select(F.col(key).alias("__kb"), *[clean(F.col(f)).alias(f"__b_{f}") for f in columns])
    joined = a.join(b, F.col("__ka") == F.col("__kb"), "full_outer")
    differs = {f: ~F.col(f"__a_{f}").eqNullSafe(F.col(f"__b_{f}")) for f in columns}
    names = F.filter(F.array(*[F.when(differs[f], F.lit(f)) for f in sorted(fields)]), lambda x: x.isNotNull())
    changed = differs[gate] if gate else F.size(names) > 0
    kind = F.when(F.col("__ka").isNull(), "new").when(F.col("__kb").isNull(), "removed").when(changed, "changed").otherwise("same")
    out = joined.select(F.coalesce("__ka", "__kb").alias(key), kind.alias("kind"), names.alias("changed_fields"))
    nothing = F.array().cast("array<string>")
    return out.withColumn("changed_fields", F.when(F.col("kind") == "changed", F.col("changed_fields")).otherwise(nothing))


def delta_counts(before: DataFrame, after: DataFrame, key: str, fields: list[str], clean=lambda c: c) -> DataFrame:
    """One row: new, removed, changed, unchanged and a count for each field; all 0 if ``before`` is empty."""
    d = diff(before, after, key, fields, clean)
    some = F.max((F.col("kind") != "new").cast("int"))
    count = lambda c: F.when(some == 1, F.sum(c.cast("long"))).otherwise(F.lit(0)).cast("long")
    kinds = [count(F.col("kind") == k).alias(f"n_{k}") for k in ("new", "removed", "changed", "same")]
    return d.agg(*kinds, *[count(F.array_contains("changed_fields", f)).alias(f"changed_{f}") for f in fields]).na.fill(0)


def alerts(before: DataFrame, after: DataFrame, key: str, score: str, threshold: int, content: str) -> DataFrame:
    """key, kind (new, removed, score, content), score_delta: a row for each alert."""
    a = before.select(F.col(key).alias("__k"), F.col(score).alias("__s"), F.col(content).alias("__c"))
    b = after.select(key, score, content)
    joined = b.join(a, F.col(key) == F.col("__k"), "full_outer")
    moved = F.col(score) - F.col("__s")
    kinds = F.when(F.col("__k").isNull(), F.array(F.lit("new"))).when(F.col(key).isNull(), F.array(F.lit("removed"))).otherwise(
        F.filter(F.array(F.when(F.abs(moved) >= threshold, "score"), F.when(F.col(content) != F.col("__c"), "content")), lambda x: x.isNotNull())
    )
    rows = joined.select(F.coalesce(key, "__k").alias(key), F.explode(kinds).alias("kind"), moved.alias("__m"))
    return rows.select(key, "kind", F.when(F.col("kind") == "score", F.col("__m")).cast("int").alias("score_delta"))


def pair_duplicates(before: DataFrame, after: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """The k-th row of a key on one side with the k-th on the other: key, k, kind, diffs (differing fields)."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    a = before.select(F.col(key).alias("__ka"), number.alias("__na"), *[F.col(f).alias(f"__a_{f}") for f in fields])
    b = after.select(F.col(key).alias("__kb"), number.alias("__nb"), *[F.col(f).alias(f"__b_{f}") for f in fields])
    joined = a.join(b, (F.col("__ka") == F.col("__kb")) & (F.col("__na") == F.col("__nb")), "full_outer")
    both = F.col("__ka").isNotNull() & F.col("__kb").isNotNull()
    diffs = reduce(add, [(~F.col(f"__a_{f}").eqNullSafe(F.col(f"__b_{f}"))).cast("int") for f in fields])
    kind = F.when(F.col("__ka").isNull(), "added").when(F.col("__kb").isNull(), "removed").when(diffs > 0, "changed").otherwise("same")
    return joined.select(
        F.coalesce("__ka", "__kb").alias(key), F.coalesce("__na", "__nb").cast("int").alias("k"), kind.alias("kind"), F.when(both, diffs).otherwise(0).alias("diffs")
    )


def identity_churn(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """(content, key, side): keys that left content or came to it, where the content goes by other keys too.

    A row for each key, not for each pair of an old and a new key: content that many keys share stays linear.
    """
    sides = before.select(content, key, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(after.select(content, key, F.lit(0).alias("__a"), F.lit(1).alias("__b")))
    keys = sides.groupBy(content, key).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"))
    side = F.when(F.col("__b") == 0, "left").when(F.col("__a") == 0, "came").otherwise("stayed")
    keys = keys.select(content, key, side.alias("side"))
    kinds = keys.groupBy(content).agg(F.count_if(F.col("side") == "left").alias("__l"), F.count_if(F.col("side") == "came").alias("__c"), F.count("*").alias("__n"))
    moved = kinds.where("(__l > 0 AND __n > __l) OR (__c > 0 AND __n > __c)").select(content)
    return keys.where("side <> 'stayed'").join(moved, content, "left_semi")


def content_fingerprint(rows: DataFrame, digest: str) -> DataFrame:
    """One row: ``fingerprint`` of all rows' hexadecimal digests, whatever their order; repeated rows count.

    Sums of all eight 32-bit parts of a 256-bit digest and the count combine before the shuffle, so no task sees all digests.
    The sums are decimals of 38 digits, which no number of rows exceeds.
    """
    starts = range(1, 65, 8)
    parts = [F.sum(F.conv(F.substring(digest, k, 8), 16, 10).cast("decimal(20,0)")).alias(f"p{k}") for k in starts]
    sums = rows.agg(F.count("*").alias("n"), *parts)
    return sums.select(F.sha2(F.concat_ws("\u001f", "n", *[F.coalesce(F.col(f"p{k}").cast("string"), F.lit("0")) for k in starts]), 256).alias("fingerprint"))


def completeness(rows: DataFrame, fields: list[str]) -> DataFrame:
    """field, share: the part of rows where the field is filled, at four places."""
    filled = [F.avg((F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) != "").cast("int")).alias(f) for f in fields]
    pairs = ", ".join(f"'{f}', `{f}`" for f in fields)
    return rows.agg(*filled).selectExpr(f"stack({len(fields)}, {pairs}) AS (field, share)").select("field", F.bround("share", 4).alias("share"))


def completeness_delta(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """field, share_before, share_after, delta."""
    a = completeness(before, fields).withColumnRenamed("share", "share_before")
    b = completeness(after, fields).withColumnRenamed("share", "share_after")
    return a.join(F.broadcast(b), "field").withColumn("delta", F.bround(F.col("share_after") - F.col("share_before"), 4))  # a row a field


def worth_showing(found: DataFrame, scores: DataFrame, key: str, score: str, floor: int, n: int) -> DataFrame:
    """The first ``n`` alerts by falling score and key, with their ``rank``; below ``floor`` only removed rows are shown."""
    from .ranking import top

    scored = found.join(scores.select(key, F.col(score).alias("score")), key, "left")
    return top(scored.where((F.col("score") >= floor) | (F.col("kind") == "removed")), [F.desc_nulls_last("score"), F.asc(key), F.asc("kind")], n)


def risk(measures: DataFrame, ladder: list[tuple[str, str, float, int]]) -> DataFrame:
    """risk_score and risk_reasons of one row of measures; ladder: reason, measure, threshold, points; at most 100."""
    on = {name: F.coalesce(F.col(m) >= t, F.lit(False)) for name, m, t, _ in ladder}
    points = F.least(F.lit(100), reduce(add, [F.when(on[name], p).otherwise(0) for name, _, _, p in ladder])).cast("int")
    reasons = F.filter(F.array(*[F.when(on[name], F.lit(name)) for name, *_ in ladder]), lambda x: x.isNotNull())
    return measures.withColumn("risk_score", points).withColumn("risk_reasons", reasons)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: n_a, n_b, only_a, only_b, equal; repeated rows count, order doesn't."""
    columns = sorted(a.columns)
    sides = a.select(*columns, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(b.select(*columns, F.lit(0).alias("__a"), F.lit(1).alias("__b")))
    counts = sides.groupBy(*columns).agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))
    out = counts.agg(
        F.sum("__a").alias("n_a"), F.sum("__b").alias("n_b"),
        F.sum(F.greatest(F.col("__a") - F.col("__b"), F.lit(0))).alias("only_a"),
        F.sum(F.greatest(F.col("__b") - F.col("__a"), F.lit(0))).alias("only_b"),
    ).na.fill(0)
    return out.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def changed_columns(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """column, n: rows of both sides in which the column differs; columns that always change are volatile."""
    columns = sorted(set(a.columns) & set(b.columns) - {key})
    left = a.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__a_{c}") for c in columns])
    joined = left.join(b, left["__k"] == b[key])
    sums = [F.sum((~F.col(f"__a_{c}").eqNullSafe(F.col(c))).cast("long")).alias(c) for c in columns]
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return joined.agg(*sums).selectExpr(f"stack({len(columns)}, {pairs}) AS (column_name, n)").na.fill(0)
