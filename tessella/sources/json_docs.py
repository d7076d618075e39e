"""JSON sources: arrays of records, tolerant of what isn't one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold one JSON array of records of a known schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """file, _ord, record (variant): the objects of arrays; other files and items are passed over.

    ``_ord`` is the place in the array, which first-wins and last-wins rules need.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    return explode_objects(files, "value")


def explode_objects(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` for each object of the JSON array in ``column``: _ord and record (variant) are added."""
    parsed = rows.withColumn("__v", F.try_parse_json(column)).drop(column)
    parsed = parsed.where(F.col("__v").isNotNull() & F.schema_of_variant("__v").startswith("ARRAY"))
    items = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("__v").outer()))
    items = items.where(F.schema_of_variant("value").startswith("OBJECT"))
    keep = [c for c in rows.columns if c != column]
    return items.select(*keep, F.col("pos").alias("_ord"), F.col("value").alias("record"))


def read_records(spark: SparkSession, path: str, key: str = "records") -> DataFrame:
    """Objects of files that hold either an array, or an object with an array under ``key``."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    v = F.try_parse_json("value")
    inner = F.to_json(F.try_variant_get(v, f"$.{key}", "variant"))
    is_array = F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    return explode_objects(files.select("file", F.when(is_array, F.col("value")).otherwise(inner).alias("value")), "value")


def field(record: Column, *paths: str) -> Column:
    """The first filled text among ``paths`` of a variant, trimmed."""
    found = [F.trim(F.try_variant_get(record, f"$.{p}", "string")) for p in paths]
    return F.coalesce(*[F.when(x != "", x) for x in found])


def first_wins(rows: DataFrame, key: str, order: str = "_ord") -> DataFrame:
    """The first row of each key; rows without a key go."""
    from ..operators.diff import one_a_key

    return one_a_key(rows.where(F.col(key).isNotNull()), key, order, last=False)


def with_ids(rows: DataFrame, id_: str, url: str, title: str) -> DataFrame:
    """A missing id becomes a digest of URL and title."""
    from ..functions.text import blank_to_null, digest

    return rows.withColumn(id_, F.coalesce(blank_to_null(F.col(id_)), digest(F.lower(F.col(url)), F.lower(F.col(title)))))
