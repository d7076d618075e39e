"""Stable identities and fingerprints of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, digest, first_filled, normalise
from .urls import canonical

#: A requisition number: letters and digits with at least one digit (own choice).
_REQUISITION = r"^[A-Za-z]{0,6}[-_]?[0-9]{2,}[A-Za-z0-9_-]*$"


def requisition(*candidates: Column) -> Column:
    """The first candidate that looks like a requisition number and is no URL."""
    cleaned = [collapse(c) for c in candidates]
    return F.coalesce(*[F.when(c.rlike(_REQUISITION) & ~F.contains(c, F.lit("://")), c) for c in cleaned])


def record_id(ids: list[Column], urls: list[Column], described_by: list[Column]) -> Column:
    """First filled id; else the first filled URL in canonical form; else a digest of the description."""
    found = first_filled(*ids)
    url = canonical(first_filled(*urls)) if urls else F.lit(None)
    return F.coalesce(found, url, digest(*[normalise(c) for c in described_by]))


def source_identity(source: Column, ids: list[Column], urls: list[Column], described_by: list[Column]) -> Column:
    """Identity within a source: its requisition number, else its canonical URL, else its description.

    The source and the kind of identity are part of the digest, so kinds never meet.
    """
    number = requisition(*ids)
    url = canonical(first_filled(*urls)) if urls else F.lit(None)
    kind = F.when(number.isNotNull(), "id").when(url.isNotNull(), "url").otherwise("text")
    value = F.coalesce(number, url, F.concat_ws("\u001f", *[normalise(c) for c in described_by]))
    return digest(normalise(source), kind, value)


def delta_id(source: Column, ids: list[Column], urls: list[Column], described_by: list[Column]) -> Column:
    """``source:`` before ``record_id``."""
    return F.concat(normalise(source), F.lit(":"), record_id(ids, urls, described_by))


def fingerprint(*fields: Column) -> Column:
    """A digest of normalised content."""
    return digest(*[normalise(f.cast("string")) for f in fields])


def path_safe(x: Column) -> Column:
    """Whether ``x`` may name a folder: no separators, no parent, a bounded length."""
    return x.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}$") & ~F.contains(x, F.lit(".."))
