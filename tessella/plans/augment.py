"""Records augmented by a provider of answers: cached by content, backfilled by rules, upgraded by version, and scored."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import coerced
from ..interfaces import AnswerProvider, ValueCache


def asked(provider: AnswerProvider, text: Column) -> Column:
    """The provider's answers, an Arrow batch at a time."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(provider.answers([t or "" for t in texts]), dtype="object")

    return run(text)


def augmented(
    rows: DataFrame, provider: AnswerProvider, cached: ValueCache, text: str, version: int, rules: Column, texts: list[str], numbers: dict[str, tuple[int, int]], lists: list[str]
) -> tuple[DataFrame, dict[str, int]]:
    """``rows`` with ``payload``, a struct of the fields that answers should have, and the cache's counters.

    Only contents that the cache lacks at this version are asked for, once each.  An answer that is no JSON is replaced by ``rules``,
    a column of JSON over the same row.  Where an outdated answer is replaced, its lists keep their items, then come the new ones.
    """
    key = "_content"
    keyed = rows.withColumn(key, F.sha2(F.concat_ws("\u001f", F.lit(provider.name), F.coalesce(F.col(text), F.lit(""))), 256))

    def make(todo: DataFrame) -> Column:
        answer = asked(provider, F.col(text))
        new = coerced(F.when(F.try_parse_json(answer).isNotNull(), answer).otherwise(rules), texts, numbers, lists)
        old = F.col("old_payload")
        if todo.schema["old_payload"].dataType.typeName() == "struct":  # there is a cache
            for name in lists:
                new = F.when(old.isNotNull(), new.withField(name, F.array_distinct(F.concat(old[name], new[name])))).otherwise(new)
        return new

    out, counters = cached.refresh(keyed, key, "payload", version, make)
    return out.drop(key), counters


def match_score(wanted: list[str], preferred: list[str], have: Column) -> Column:
    """0 to 100: the share of wanted items, which count twice, and of preferred ones among ``have``."""
    hits = lambda items: F.size(F.array_intersect(F.array(*map(F.lit, items)), F.coalesce(have, F.array().cast("array<string>"))))
    return F.floor((2 * hits(wanted) + hits(preferred)) * 100 / (2 * len(wanted) + len(preferred))).cast("int")
