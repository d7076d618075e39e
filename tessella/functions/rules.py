"""Rules as data, compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Weighs how densely ``terms`` (whole words of ASCII letters and digits) stand in a scope, title or text."""

    name: str
    terms: tuple[str, ...]
    weight: int
    scope: str = "text"


@dataclass(frozen=True)
class ScoreModel:
    """Own parameters: occurrences count in a thousand words, and rows may have attributes that earn points."""

    rules: tuple[Rule, ...]
    floor_words: int = 50  # a scope with fewer words is measured as if it had so many
    ceiling: int = 60  # occurrences in a thousand words that count at most
    attributes: tuple[tuple[str, str, int], ...] = ()  # column, value, points
    bands: tuple[tuple[str, int, int], ...] = ()  # band, percent of the points, points after that
    damped: tuple[int, int] = (0, 100)  # in scopes of fewer words, rules that take points take this percent of them
    pins: tuple[tuple[str, str, int], ...] = ()  # column, value, the least adjusted score of rows that have it


def bound(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``rows`` with columns that are computed once, whatever filters and expressions use them later.

    They come out of a generator, through which Catalyst neither pushes predicates nor folds projections.
    """
    made = F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()])))
    return rows.select("*", made.alias(*values))


def score(rows: DataFrame, model: ScoreModel, title: str, text: str, band: str | None = None) -> DataFrame:
    """``rows`` with raw_score, adjusted_score, final_score and score_hits (rule, count, points).

    One scan of each scope finds all rules' terms.  Hits are ordered by absolute points, ties in the rules' order.
    """
    low = {"title": F.lower(F.coalesce(F.col(title), F.lit(""))), "text": F.lower(F.coalesce(F.col(text), F.lit("")))}
    values = {}
    for scope in sorted({r.scope for r in model.rules}):
        terms = "|".join(sorted({t for r in model.rules if r.scope == scope for t in r.terms}))
        values[f"_{scope}"] = F.regexp_extract_all(low[scope], F.lit(f"(?<![a-z0-9])({terms})(?![a-z0-9])"), F.lit(1))
        values[f"_{scope}_words"] = F.regexp_count(low[scope], F.lit("[a-z0-9]+"))
    found = bound(rows, values)
    counts = {f"_c{i}": _among(F.col(f"_{r.scope}"), r.terms) for i, r in enumerate(model.rules)}
    found = bound(found, counts)
    hits = []
    for i, r in enumerate(model.rules):
        words = F.greatest(F.col(f"_{r.scope}_words"), F.lit(model.floor_words))
        dense = F.least(F.lit(model.ceiling), F.floor(F.col(f"_c{i}") * 1000 / words))
        points = r.weight * dense
        if r.weight < 0 and model.damped[0]:
            points = F.when(F.col(f"_{r.scope}_words") < model.damped[0], F.ceil(points * model.damped[1] / 100)).otherwise(points)
        hits.append((r.name, F.col(f"_c{i}"), points.cast("int")))
    for column, value, points in model.attributes:
        has = F.coalesce(F.col(column).cast("string") == value, F.lit(False)).cast("int")
        hits.append((f"{column}={value}", has, has * points))
    structs = [F.struct((-F.abs(p)).alias("o"), F.lit(i).alias("i"), F.lit(name).alias("rule"), n.alias("count"), p.alias("points")) for i, (name, n, p) in enumerate(hits)]
    ordered = F.array_sort(F.filter(F.array(*structs), lambda h: h["count"] > 0))
    raw = reduce(add, [points for *_, points in hits]).cast("int")
    percent, after = F.lit(100), F.lit(0)
    for name, share, points in model.bands if band else ():
        percent, after = F.when(F.col(band) == name, share).otherwise(percent), F.when(F.col(band) == name, points).otherwise(after)
    scored = found.withColumns({"raw_score": raw, "score_hits": F.transform(ordered, lambda h: F.struct(h["rule"], h["count"], h["points"]))})
    scored = scored.withColumn("adjusted_score", (F.floor(F.col("raw_score") * percent / 100) + after).cast("int"))
    for column, value, least in model.pins:
        pinned = F.coalesce(F.col(column).cast("string") == value, F.lit(False))
        scored = scored.withColumn("adjusted_score", F.when(pinned, F.greatest("adjusted_score", F.lit(least))).otherwise(F.col("adjusted_score")))
    return scored.withColumn("final_score", clamp(F.col("adjusted_score"))).drop(*values, *counts)


def _among(found: Column, terms: tuple[str, ...]) -> Column:
    return F.size(F.filter(found, lambda t: t.isin(*terms)))


def clamp(x: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x)).cast("int")


def pull(score: Column, other: Column, gain: float) -> Column:
    """``score`` moved toward a second score by ``gain`` times the root of their distance, never past it.

    Small disagreements are settled, large ones are trusted less and less.  Where ``other`` is null nothing moves.
    """
    apart = other - score
    step = F.least(F.abs(apart), F.floor(gain * F.sqrt(F.abs(apart))))
    return F.when(other.isNull(), score).otherwise(score + F.signum(apart) * step).cast("int")


def with_aliases(terms: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    """``terms`` and, after every alias among them, the terms that it stands for; ``terms`` is used once."""
    pairs = [x for a, of in sorted(aliases.items()) for x in (F.lit(a), F.array(*map(F.lit, of)))]
    meant = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,array<string>>")
    return F.array_distinct(F.flatten(F.transform(terms, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(meant, t), F.array().cast("array<string>"))))))


def first_match(x: Column, cases: list[tuple[str, str]], default: str) -> Column:
    """The name of the first pattern that ``x`` has, else ``default``."""
    out = F.lit(default)
    for name, pattern in reversed(cases):
        out = F.when(x.rlike(pattern), name).otherwise(out)
    return out


def cascade(x: Column, steps: list[tuple[str, str, str, str]], default: tuple[str, str, str]) -> Column:
    """struct(norm, flag, reason) of the first step (pattern, norm, flag, reason) that ``x`` fits, else of ``default``."""
    as_struct = lambda norm, flag, reason: F.struct(F.lit(norm).alias("norm"), F.lit(flag).alias("flag"), F.lit(reason).alias("reason"))
    out = as_struct(*default)
    for pattern, *rest in reversed(steps):
        out = F.when(x.rlike(pattern), as_struct(*rest)).otherwise(out)
    return out


def all_matches(x: Column, cases: list[tuple[str, str]]) -> Column:
    """The sorted names of all patterns that ``x`` has."""
    return F.array_sort(F.filter(F.array(*[F.when(x.rlike(p), F.lit(name)) for name, p in cases]), lambda n: n.isNotNull()))


def points_class(x: Column, rejects: list[str], tiers: list[tuple[str, int]], high: int, low: int) -> Column:
    """A three-way class: 'no' on a hard reject, else by the points of all patterns that ``x`` has."""
    points = reduce(add, [F.when(x.rlike(p), n).otherwise(0) for p, n in tiers])
    rejected = reduce(lambda a, b: a | b, [x.rlike(p) for p in rejects])
    return F.when(rejected, "no").when(points >= high, "yes").when(points >= low, "maybe").otherwise("no")


def explain(hits: Column, k: int = 3) -> Column:
    """The top ``k`` hits as text."""
    return F.array_join(F.transform(F.slice(hits, 1, k), lambda h: F.format_string("%s x%d (%d)", h["rule"], h["count"], h["points"])), "; ")
