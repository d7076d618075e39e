"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track (own choice).
TRACKING = ("ref", "fbclid", "gclid")
TRACKING_PREFIXES = ("utm_",)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_string(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def canonical(url: Column, tracking=TRACKING, prefixes=TRACKING_PREFIXES) -> Column:
    """Lower-case scheme and host, no trailing slashes, parameters without tracking and in order, no fragment.

    Parameters are percent-decoded, so that different writings of one are the same, put in order whatever their case (then by
    case), and encoded again; what can't be decoded stays as it is.  What has no scheme is only trimmed; null stays null.
    """
    name = lambda p: F.lower(F.element_at(F.split(p, "="), 1))
    plain = lambda p: F.coalesce(F.try_url_decode(p), p)

    def same(p: Column) -> Column:
        at = F.instr(p, F.lit("="))
        value = F.concat(F.lit("="), F.url_encode(plain(F.substr(p, at + 1))))
        return F.when(at > 0, F.concat(F.url_encode(plain(F.substr(p, F.lit(1), at - 1))), value)).otherwise(F.url_encode(plain(p)))

    def kept(p: Column) -> Column:
        good = (p != "") & ~name(p).isin(*tracking)
        for prefix in prefixes:
            good = good & ~F.startswith(name(p), F.lit(prefix))
        return good

    coded = F.filter(F.transform(F.split(query_string(url), "&"), same), kept)
    in_order = F.array_sort(F.transform(coded, lambda p: F.struct(F.lower(plain(p)).alias("folded"), p.alias("p"))))
    params = F.array_join(F.transform(in_order, lambda x: x["p"]), "&")
    base = F.concat(scheme(url), F.lit("://"), authority(url), F.rtrim(path(url), F.lit("/")))
    whole = F.when(params != "", F.concat(base, F.lit("?"), params)).otherwise(base)
    return F.when(scheme(url) == "", F.trim(url)).otherwise(whole)


def numeric_id(url: Column) -> Column:
    """The last number that makes a whole path segment (an extension aside); empty if there is none."""
    return F.regexp_extract(path(url), r"/([0-9]+)(?:\.[a-z]+)?/*$", 1)


def resolve(base: Column, link: Column) -> Column:
    """``link`` as seen from the page ``base``; where that has no scheme, only a link that has one itself is known, else null."""
    root = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(scheme(base) == "", F.lit(None))
        .when(F.startswith(link, F.lit("//")), F.concat(scheme(base), F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )
