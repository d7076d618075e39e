"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separates fields that are hashed together; it doesn't occur in text.
UNIT = "\u001f"
#: Runs of Unicode White_Space (fixed values), in a form that Java and RE2 both read.
SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: Those runs that are not one plain space already: most spaces of a text need no replacement.
_ODD_SPACE = f" {SPACE}|{SPACE.replace(' ', '', 1)[:-1]}{SPACE[:-1]}*"


def blank_to_null(x: Column) -> Column:
    """Null for null, empty and blank strings."""
    return F.when(F.trim(x) != "", x)


def first_filled(*xs: Column) -> Column:
    """The first value that is neither null nor blank, trimmed."""
    return F.coalesce(*[F.trim(blank_to_null(x)) for x in xs])


def collapse(x: Column) -> Column:
    """White space runs, of any Unicode kind, become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(x, _ODD_SPACE, " "))


def normalise(x: Column) -> Column:
    """``collapse`` in lower case; null counts as empty."""
    return F.lower(collapse(F.coalesce(x, F.lit(""))))


def digest(*xs: Column) -> Column:
    """SHA-256 over fields; a null field counts as empty."""
    return F.sha2(F.concat_ws(UNIT, *[F.coalesce(x.cast("string"), F.lit("")) for x in xs]), 256)


def shorten(x: Column, n: int) -> Column:
    """At most ``n`` characters; an ellipsis replaces what is cut."""
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, n - 1)), F.lit("…")))


def tokens(x: Column) -> Column:
    """Lower-case ASCII letters and digits in runs."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def mentions(x: Column, term: str) -> Column:
    """Whether ``term`` (a regular expression) stands in ``x`` between non-letters."""
    return x.rlike(rf"(^|[^\p{{L}}\p{{N}}])({term})([^\p{{L}}\p{{N}}]|$)")


def cut_at_marker(x: Column, markers: list[str]) -> Column:
    """``x`` up to the earliest marker that isn't at its start; markers are found without regard to case."""
    low = F.lower(x)
    places = [F.nullif(F.instr(low, m.lower()), F.lit(0)) for m in markers]
    first = F.least(*places) if len(places) > 1 else places[0]
    return F.when(first > 1, F.rtrim(F.substr(x, F.lit(1), first - 1))).otherwise(x)


def sections(x: Column, wanted: str, optional: str) -> Column:
    """struct(before, wanted, optional): the text before either marker and after each, up to the other."""
    low = F.lower(x)
    a, b = F.instr(low, wanted.lower()), F.instr(low, optional.lower())
    end = F.length(x) + 1
    before = F.when((a == 0) & (b == 0), x).otherwise(F.substr(x, F.lit(1), F.least(F.when(a > 0, a).otherwise(end), F.when(b > 0, b).otherwise(end)) - 1))
    of_a = F.when(a == 0, "").otherwise(F.substr(x, a, F.when(b > a, b).otherwise(end) - a))
    of_b = F.when(b == 0, "").otherwise(F.substr(x, b, F.when(a > b, a).otherwise(end) - b))
    return F.struct(before.alias("before"), of_a.alias("wanted"), of_b.alias("optional"))


def trigger(x: Column, terms: list[str], around: int = 20) -> Column:
    """struct(term, context) of the first of ``terms`` found, in their order; null if there is none."""
    low = F.lower(x)
    out = None
    for term in reversed(terms):
        at = F.instr(low, term.lower())
        start = F.greatest(F.lit(1), at - around)
        hit = F.struct(F.lit(term).alias("term"), F.substr(x, start, at + len(term) + around - start).alias("context"))
        out = F.when(at > 0, hit) if out is None else F.when(at > 0, hit).otherwise(out)
    return out


def html_text(x: Column) -> Column:
    """Text of HTML by patterns: scripts, styles and tags go, white space collapses."""
    x = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?is)<script[^>]*>.*?</script>", " ")
    x = F.regexp_replace(x, r"(?is)<style[^>]*>.*?</style>", " ")
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return collapse(x)
