"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents are taken ``target / size`` times in the mean: the whole part for every document,
the rest by rounding.  The pivotal method lets two documents with fractional probabilities meet and
moves mass between them, in a random direction, until one becomes 0 or 1.  Mass is measured in words,
so the source's expected words stay what they are in every meeting, while each document keeps its
probability in the mean.  Documents meet inside blocks first; every block leaves at most one
fractional document, and these meet again ``FAN_IN`` blocks at a time in a reduction tree, until a
source has one left, which goes to the nearer end.  The words taken miss the target by half of that
document at most; long documents meet first, so that a short one tends to be left.

Randomness comes from the document and a seed, so reruns agree.

Defined results: a null text has size 0; documents of size 0 are taken by the whole part only and count
nothing; a null source is a source of its own, ordered last; repeated rows are documents of their
own; a very long text is a document like any other, and its source misses the target by half of it at most; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, columns, cut, rounds

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Documents that meet in a block, and blocks whose rests meet in the next level.
BLOCK, FAN_IN, SEED = 4_096, 256, 20_240
_TINY = 1e-12
_ROW = "doc_id long, source string, text_hash long, size long, whole int, p double, block long, source_size long, target double"


def size(text: Column) -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes(source, source_size, docs)`` with each source's ``target``: water-filling over sources.

    Sources by ``cap / weight`` fill up first; the level is what the rest share by weight.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("_i", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by_fill = Window.orderBy(F.col("_cap") / F.col("_w"), "_i")
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    open_ = F.when(level * F.col("_w") < F.col("_cap"), level)
    filled = ranked.withColumn("_open", open_)
    # the first source, by cap / weight, that its share at the level doesn't fill sets the level of all after it
    first = F.first("_open", ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, 0))
    target = F.coalesce(F.least(first * F.col("_w"), "_cap"), "_cap")
    return filled.withColumn("target", target).select("source", "source_size", "docs", "target")


def pivot(p: np.ndarray, words: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Rounds ``p`` until at most one is fractional, keeping ``sum(p * words)``; ``words`` are positive."""
    p, words, draws = p.tolist(), words.tolist(), draws.tolist()
    held = -1
    for i, x in enumerate(p):
        if not _TINY < x < 1 - _TINY:
            p[i] = float(round(x))
            continue
        if held < 0:
            held = i
            continue
        a, b, wa, wb = p[held], x, words[held], words[i]
        up = min((1 - a) * wa, b * wb)  # words that can move from i to held
        down = min(a * wa, (1 - b) * wb)
        moved = up if draws[i] * (up + down) < down else -down
        p[held], p[i] = a + moved / wa, b - moved / wb
        loose = []
        for k in (held, i):
            if _TINY < p[k] < 1 - _TINY:
                loose.append(k)
            else:
                p[k] = float(round(p[k]))
        held = loose[0] if loose else -1
    return np.array(p)


def _draws(text_hash: np.ndarray, doc_id: np.ndarray, level: int) -> np.ndarray:
    """A number in [0, 1) for each row, from its hash and the level."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    h = text_hash.view(np.uint64) ^ (doc_id.view(np.uint64) * odd) ^ np.uint64((SEED + level) * int(odd) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h >> np.uint64(11)).astype(float) / float(1 << 53)


def _meet(level: int):
    def run(rows: pa.Table) -> pa.Table:
        doc_id = rows["doc_id"].fill_null(-1).to_numpy()
        text_hash, words, p = (rows[c].to_numpy() for c in ("text_hash", "size", "p"))
        order = np.lexsort((p, doc_id, text_hash, -words))  # long ones first, so that a short one is left
        rounded = pivot(p[order], words[order].astype(float), _draws(text_hash, doc_id, level)[order])
        at = rows.schema.get_field_index("p")
        return rows.take(pa.array(order)).set_column(at, "p", pa.array(rounded))

    return run


def _fractional() -> Column:
    return (F.col("p") > _TINY) & (F.col("p") < 1 - _TINY)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target, copies for every document."""
    base = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
            size(F.col("text")).alias("size"),
        )
    )
    sizes = cut(targets(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), weights, share, most))
    largest = sizes.agg(F.max("docs")).first()[0] or 0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    blocks = F.ceil(F.col("docs") / block)
    rows = base.join(sizes.withColumnRenamed("source", "_s"), base["source"].eqNullSafe(F.col("_s"))).select(
        "doc_id", "source", "text_hash", "size",
        F.floor(ratio + _TINY).cast("int").alias("whole"),
        F.when((F.col("size") > 0) & (ratio > F.floor(ratio + _TINY)), ratio - F.floor(ratio + _TINY)).otherwise(0.0).alias("p"),
        F.pmod(F.xxhash64("text_hash", "doc_id"), blocks).alias("block"),
        "source_size", "target",
    )
    done: list[DataFrame] = []
    n_blocks = -(-largest // block)
    for level in range(1 + (rounds(n_blocks, FAN_IN) if n_blocks > 1 else 0)):
        if level:
            rows = rows.withColumn("block", F.floor(F.col("block") / FAN_IN))
        rows = cut(rows.groupBy("source", "block").applyInArrow(_meet(level), _ROW))
        done.append(rows.where(~_fractional()))
        rows = rows.where(_fractional())
    done.append(rows.withColumn("p", (F.col("p") >= 0.5).cast("double")))  # at most one a source
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "text_hash", "size", "source_size", "target", (F.col("whole") + F.round("p").cast("int")).alias("copies"))


def take(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; all columns are kept, whatever their names.

    Of rows that are equal in id, source and text, those come first whose other columns' JSON has the smaller hash.
    """
    key = ["_key", "_text"]
    keyed = lambda h: F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), h).alias("_key")
    decided = mix(docs, **how).select(keyed("text_hash"), F.col("text_hash").alias("_text"), "copies")
    decided = decided.groupBy(*key).agg(F.sort_array(F.collect_list("copies")).alias("_copies"))
    whole = F.struct(*columns(docs)).alias("_row")  # the columns' names cannot clash inside
    rest = F.xxhash64(F.to_json(F.struct(F.lit(0).alias("_"), *[c for c, name in zip(columns(docs), docs.columns) if name != "text"]))).alias("_rest")
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    own = docs.select(whole, rest, text.alias("_text"), keyed(text))
    joined = own.join(decided, key).withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy("_rest")))
    times = F.sequence(F.lit(0), F.element_at("_copies", F.col("_rank")))
    return joined.withColumn("_time", F.explode(times)).where("_time > 0").select("_row.*")
