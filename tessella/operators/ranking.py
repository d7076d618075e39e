"""Canonical rows, families, ranks and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import working_folder


def canonical(rows: DataFrame, group: list[str], best: list[Column], provenance: str) -> DataFrame:
    """One row a group, the smallest by ``best``, with ``n_duplicates``, the number of the others.

    Equal keys are settled by ``provenance``, nulls last.  Both are aggregates that combine before the
    shuffle, so a group with a large part of all rows moves one row for each task.
    """
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(best)], F.col(provenance).isNull().alias("n"), F.col(provenance).alias("p"))
    found = rows.groupBy(*group).agg(F.min_by(F.struct(*rows.columns), key).alias("__best"), (F.count("*") - 1).alias("n_duplicates"))
    return found.select(*[F.col(f"__best.{c}").alias(c) for c in rows.columns], "n_duplicates")


def kept_rows(rows: DataFrame, group: list[str], best: list[Column], provenance: str) -> DataFrame:
    """``rows`` with ``kept_<provenance>``: the one of their group that ``canonical`` keeps; no list of a group is made."""
    rows = _kept(rows, "rows")  # they are used twice, and may cost more than reading them
    one = canonical(rows, group, best, provenance).select(*[F.col(g).alias(f"__{g}") for g in group], F.col(provenance).alias(f"kept_{provenance}"))
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group]
    return rows.join(one, same).drop(*[f"__{g}" for g in group])


def families(rows: DataFrame, family: str, score: str, order: str, first: int = 5) -> DataFrame:
    """family, the best row's order and score, how many rows, and the ``first`` rows' (id, score), best first; ties keep the first.

    Rows beyond the first are cut by rank, in every partition before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(family).orderBy(F.desc(score), F.asc(order)))
    top_rows = rows.select(family, score, order).withColumn("__r", rank).where(F.col("__r") <= first)
    variant = F.struct(F.col("__r"), F.col(order).alias("id"), F.col(score).alias("score"))
    heads = top_rows.groupBy(family).agg(F.array_sort(F.collect_list(variant)).alias("variants"))
    counts = rows.groupBy(F.col(family).alias("__f")).agg(F.count("*").alias("n"))
    joined = heads.join(counts, F.col(family).eqNullSafe(F.col("__f")))
    listed = F.transform("variants", lambda v: F.struct(v["id"], v["score"]))
    return joined.select(family, F.col("variants")[0]["id"].alias("best_id"), F.col("variants")[0]["score"].alias("best_score"), "n", listed.alias("variants"))


def top(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows with their ``rank``: a distributed top-n first, then a rank over only those."""
    return rows.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


#: Groups of at most so many rows that may still fit are folded in one expression.
FOLDED = 4096
#: Places whose costs are summed in one go.
BLOCK = 1 << 16


def greedy_budget(rows: DataFrame, group: str, order: str, cost: str, budget: int, free: str | None = None, folded: int = FOLDED) -> DataFrame:
    """group, order, selected: in order, a row is taken if it still fits its group's budget, else passed over.

    Rows marked ``free`` are taken and spend nothing; rows that alone exceed the budget are passed over where they
    are.  A null or negative cost is 0; equal orders are settled by the smaller cost; nulls come first.

    A group of many rows is not streamed through one task.  With R left, rows cost more than R / 2 (of which one at most can
    be taken) or less.  The sums of the lesser costs tell, in parallel, the first place where either a larger row fits or a lesser one does
    not; up to it the lesser rows are taken and the larger passed over, and after it less than R / 2 is left.  So as many phases as
    R has bits settle any group, each over those rows alone that may still fit; once they are ``folded`` or fewer one expression
    folds them.
    """
    item = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.greatest(F.coalesce(F.col(cost).cast("long"), F.lit(0)), F.lit(0)).alias("c"), F.coalesce(F.col(free) if free else F.lit(False), F.lit(False)).alias("free"))
    item = item.withColumn("sure", F.when(F.col("free"), True).when(F.col("c") > budget, False))
    out = item.where("sure IS NOT NULL").select("g", "o", F.col("sure").alias("selected"))
    open_ = item.where("sure IS NULL").select("g", "o", "c")
    counts = open_.groupBy(F.col("g").alias("k")).agg(F.count("*").alias("n"))
    if counts.where(F.col("n") > folded).isEmpty():
        out = out.unionByName(_folded(open_, F.lit(budget)))
    else:
        sized = open_.join(counts, F.col("g").eqNullSafe(F.col("k"))).drop("k")
        out = out.unionByName(_folded(sized.where(F.col("n") <= folded), F.lit(budget))).unionByName(_phases(sized.where(F.col("n") > folded), budget, folded))
    return out.select(F.col("g").alias(group), F.col("o").alias(order), "selected")


def _folded(rows: DataFrame, left: Column) -> DataFrame:
    """(g, o, selected) of groups small enough for a list; ``left`` is what a group may spend."""
    lists = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("o", "c"))).alias("l"), F.max(left).alias("r"))
    start = F.struct(F.col("r").cast("long").alias("r"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("t"))
    step = lambda a, x: F.struct(
        F.when(x["c"] <= a["r"], a["r"] - x["c"]).otherwise(a["r"]).alias("r"), (a["i"] + 1).alias("i"), F.when(x["c"] <= a["r"], F.concat(a["t"], F.array(a["i"]))).otherwise(a["t"]).alias("t")
    )
    taken = lists.select("g", "l", F.aggregate("l", start, step, lambda a: a["t"]).alias("t"))
    return taken.select("g", F.inline(F.transform("l", lambda x, i: F.struct(x["o"].alias("o"), F.array_contains("t", i).alias("selected")))))


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once to the shared folder and read from there."""
    path = working_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _phases(rows: DataFrame, budget: int, folded: int) -> DataFrame:
    """(g, o, selected) of large groups; see ``greedy_budget``."""
    placed = _kept(positions(rows.select("g", "o", "c"), ["g"], [F.col("o").asc_nulls_first(), F.col("c")], "at"), "placed")
    left = placed.select("g").distinct().select(F.col("g").alias("k"), F.lit(budget).cast("long").alias("r"), F.lit(0).cast("long").alias("start"))
    same = F.col("g").eqNullSafe(F.col("k"))
    taken, last = None, None
    while True:
        open_ = placed.join(left, same).where("at >= start AND c <= r").drop("k")
        number = open_.groupBy(F.col("g").alias("k")).agg(F.count("*").alias("n"))
        open_ = _kept(open_.join(number, same).drop("k"), "may-fit")
        few = open_.where(F.col("n") <= folded)
        last = few if last is None else last.unionByName(few)
        open_ = open_.where(F.col("n") > folded).withColumns({"small": F.col("c") * 2 <= F.col("r"), "block": F.floor(F.col("at") / BLOCK)})
        if open_.isEmpty():
            break
        own = F.when(F.col("small"), F.col("c")).otherwise(0)
        blocks = open_.groupBy(F.col("g").alias("k"), F.col("block").alias("b")).agg(F.sum(own).alias("sum"))
        earlier = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.select("k", "b", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
        inside = Window.partitionBy("g", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        spent = open_.withColumn("inside", F.coalesce(F.sum(own).over(inside), F.lit(0))).join(blocks, same & (F.col("block") == F.col("b")))
        spent = _kept(spent.withColumn("spent", F.col("inside") + F.col("before")).select("g", "o", "c", "at", "r", "small", "spent"), "spent")
        over = F.col("spent") + F.col("c") > F.col("r")
        event = F.when(F.col("small") == over, F.struct("at", "small", "spent", "c"))
        events = _kept(spent.groupBy(F.col("g").alias("k")).agg(F.min(event).alias("e"), F.max("r").alias("r0")), "events")
        now = spent.join(events, same).where((F.col("small") & (F.col("e").isNull() | (F.col("at") < F.col("e.at")))) | (~F.col("small") & (F.col("at") == F.col("e.at"))))
        now = now.select("g", "at")
        taken = now if taken is None else taken.unionByName(now)
        left = events.where("e IS NOT NULL").select("k", (F.col("r0") - F.col("e.spent") - F.when(F.col("e.small"), 0).otherwise(F.col("e.c"))).alias("r"), (F.col("e.at") + 1).alias("start"))
    # the rest's lists: places stand for orders, so that equal orders stay apart
    rest = _folded(last.select("g", F.col("at").alias("o"), "c", "r"), F.col("r")).where("selected").select("g", F.col("o").alias("at"))
    taken = rest if taken is None else taken.unionByName(rest)
    taken = taken.select(F.col("g").alias("k"), F.col("at").alias("a"))
    found = placed.join(taken, same & (F.col("at") == F.col("a")), "left")
    return found.select("g", "o", F.col("a").isNotNull().alias("selected"))


def capped(rows: DataFrame, order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of the whole, in ``order``; places are counted by ranges, so no task has to see all rows before the cap."""
    name = next(n for k in range(len(rows.columns) + 1) if (n := f"_nth{k}") not in rows.columns)
    return positions(rows, [], order, name).where(F.col(name) < cap).drop(name)


def positions(rows: DataFrame, by: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """``rows`` with each row's place (from 0) in its group, in ``order``; no group is gathered in one task.

    Rows are dealt to ranges of group and order; a row's place is its place in its range and group, and the
    number of the group's rows in the ranges before.  Only those numbers, one for each group and range, meet by group.
    Nulls in ``by`` are a group; which of two rows that ``order`` does not tell apart comes first is not defined.
    """
    path = working_folder(rows.sparkSession, "ranges")
    # names that are free: other columns may have any
    part, place = (next(n for k in range(len(rows.columns) + 1) if (n := f"_{kind}{k}") not in rows.columns) for kind in ("range", "place"))
    rows.repartitionByRange(*[F.col(c) for c in by], *order).withColumn(part, F.spark_partition_id()).write.parquet(path)
    ranges = rows.sparkSession.read.parquet(path)
    keys = [F.col(c).alias(f"_key{k}") for k, c in enumerate(by)]
    names = [f"_key{k}" for k in range(len(by))]
    counted = ranges.groupBy(*keys, F.col(part).alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.select(*names, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(part, *by).orderBy(*order)) - 1
    placed = ranges.withColumn(place, inside).alias("r")
    same = F.col(f"r.{part}") == F.col("c._part")
    for k, c in enumerate(by):
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"c._key{k}"))
    found = (F.col(f"r.{place}") + F.col("c._before")).cast("long").alias(name)
    return placed.join(counted.alias("c"), same).select(*[F.col(f"r.`{c}`") for c in rows.columns], found)
