"""Money, time, status and failure functions as column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_estimate(x: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(x, F.lit(""))) / 4)).cast("long")


def cost(units: Column, per_thousand: str) -> Column:
    """Decimal price, half up at six places."""
    each = str(Decimal(per_thousand) / 1000)
    return F.round(units.cast("decimal(18,0)") * F.lit(each).cast("decimal(18,12)"), 6).cast("decimal(18,6)")


def iso_week(ts: Column) -> Column:
    """Such as 2026-W53, by ISO 8601."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def run_time(run_id: Column) -> Column:
    """The time in a run id such as 20260102T030405Z or an ISO time; null if there is none."""
    compact = F.try_to_timestamp(F.regexp_extract(run_id, r"([0-9]{8}T[0-9]{6})Z?", 1), F.lit("yyyyMMdd'T'HHmmss"))
    plain = F.try_to_timestamp(F.regexp_extract(run_id, r"([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2})", 1))
    return F.coalesce(compact, plain)


def status(x: Column, known: tuple[str, ...]) -> Column:
    """A known status in lower case; null for anything else."""
    cleaned = F.lower(F.trim(x))
    return F.when(cleaned.isin(*known), cleaned)


#: First digits of status codes and the standard's names for them (fixed values).
HTTP_CATEGORIES = ("informational", "successful", "redirection", "client_error", "server_error")
#: Client errors that later attempts may not meet (own choice); server errors may pass too, unless the method isn't implemented.
TRANSIENT, LASTING = (408, 421, 425, 429), (501, 505)


def http_category(code: Column) -> Column:
    """The standard's category of a status code; null outside 100 to 599."""
    return F.when(code.between(100, 599), F.element_at(F.array(*map(F.lit, HTTP_CATEGORIES)), F.floor(code / 100).cast("int")))


def http_transient(code: Column) -> Column:
    """Whether another attempt may succeed."""
    return code.isin(*TRANSIENT) | (code.between(500, 599) & ~code.isin(*LASTING))


def codes(cases: list[tuple[str, Column]]) -> Column:
    """The sorted names of the conditions that hold."""
    hit = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in cases])
    return F.array_sort(F.array_distinct(F.filter(hit, lambda x: x.isNotNull())))
