"""What may be exchanged: backends of embeddings and of answers, caches, and where runs are kept.

Each is a protocol with an implementation that needs no network; plans take any other that fits.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors
from .operators import cache
from .sources import publishing


class EmbeddingBackend(Protocol):
    """Vectors of texts, as a column of arrays of doubles; ``name`` and ``version`` are part of cache keys."""

    name: str
    version: int

    def embed(self, text: Column) -> Column: ...


class AnswerProvider(Protocol):
    """Answers to texts, a batch at a time in a worker: JSON records, or None where there is no answer."""

    name: str

    def answers(self, texts: list[str]) -> list[str | None]: ...


class ValueCache(Protocol):
    """Values by key and version; ``make`` gives what is missing or outdated."""

    def refresh(self, rows: DataFrame, key: str, value: str, version: int, make: Callable[[DataFrame], Column], fallback: Column | None = None) -> tuple[DataFrame, dict[str, int]]: ...


class RunRepository(Protocol):
    """Runs by owner."""

    def index(self) -> DataFrame: ...

    def resolve(self, pointers: DataFrame) -> DataFrame: ...


class TextHashBackend:
    """``functions.vectors.text_vector``: repeatable, without meaning."""

    name, version = "text-hash", 1

    def embed(self, text: Column) -> Column:
        return vectors.text_vector(text)


class FolderCache:
    """A versioned cache in a folder; see ``operators.cache``."""

    def __init__(self, path: str):
        self.path = path

    def refresh(self, rows, key, value, version, make, fallback=None):
        return cache.refreshed(rows, self.path, key, value, version, make, fallback)


class FolderRuns:
    """Runs in a folder with an index; see ``sources.publishing``."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def index(self) -> DataFrame:
        return publishing.read_index(self.spark, self.base)[0]

    def resolve(self, pointers: DataFrame) -> DataFrame:
        return publishing.resolve(self.index(), pointers)


def content_key(backend: EmbeddingBackend, text: Column) -> Column:
    """A cache key of a text for a backend."""
    return F.sha2(F.concat_ws("\u001f", F.lit(backend.name), F.coalesce(text, F.lit(""))), 256)
