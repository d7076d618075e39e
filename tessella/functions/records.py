"""Checks of semi-structured records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def enrichment(api_text: Column, html_text: Column, error: Column, least: int = 200) -> Column:
    """struct(status, reason, needs_fallback) from what two ways of fetching a record's text gave.

    The first way counts if its text is long enough, else the second's does; an error or nothing at all
    makes the record unavailable, a short text leaves it for another try.
    """
    api, html = F.length(F.coalesce(api_text, F.lit(""))), F.length(F.coalesce(html_text, F.lit("")))
    status = F.when((api >= least) | (html >= least), "enriched").when(error.isNotNull() & (api + html == 0), "unavailable").when(api + html == 0, "empty").otherwise("partial")
    reason = F.when(api >= least, "api").when(html >= least, "html").when(error.isNotNull() & (api + html == 0), F.concat(F.lit("error:"), error)).when(api + html == 0, "no_text").otherwise("short_text")
    return F.struct(status.alias("status"), reason.alias("reason"), ((api < least) & status.isin("partial", "empty")).alias("needs_fallback"))


def coerced(record: Column, texts: list[str], numbers: dict[str, tuple[int, int]], lists: list[str]) -> Column:
    """struct of a JSON record's fields as the kinds they should have.

    Texts are trimmed and null if blank; numbers may be text, are truncated and kept within their bounds; lists may be
    one text with commas, and lose blank and repeated items.  What can't be read is null, or an empty list.
    """
    v = F.try_parse_json(record)
    get = lambda name: F.trim(F.try_variant_get(v, f"$.{name}", "string"))
    out = [F.nullif(get(n), F.lit("")).alias(n) for n in texts]
    for n, (low, high) in numbers.items():
        number = get(n).try_cast("double")
        out.append(F.when(number.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), number)).cast("int")).alias(n))
    for n in lists:
        items = F.coalesce(F.try_variant_get(v, f"$.{n}", "array<string>"), F.split(get(n), ","), F.array().cast("array<string>"))
        out.append(F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")).alias(n))
    return F.struct(*out)


def problems(record: Column, required: dict[str, str]) -> Column:
    """Paths that a JSON record lacks or that hold another kind: sorted ``path: problem``.

    ``required``: top-level key -> STRING, BIGINT, DOUBLE, BOOLEAN, ARRAY or OBJECT; whole numbers pass for DOUBLE.
    """
    v = F.try_parse_json(record)
    found = []
    for name, kind in sorted(required.items()):
        at = F.try_variant_get(v, f"$.{name}", "variant")
        is_ = F.regexp_extract(F.schema_of_variant(at), "^([A-Z]+)", 1)
        good = is_.isin("BIGINT", "DECIMAL", "DOUBLE") if kind == "DOUBLE" else is_ == kind
        found.append(F.when(at.isNull(), F.lit(f"$.{name}: missing")).when(~good, F.concat(F.lit(f"$.{name}: "), F.lower(is_))))
    nothing = F.array(F.lit("$: no JSON"))
    return F.when(v.isNull(), nothing).otherwise(F.filter(F.array(*found), lambda x: x.isNotNull()))
