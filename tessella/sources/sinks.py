"""Sinks: canonical artifacts, tables of state, and reports of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical_json(rows: DataFrame) -> DataFrame:
    """One column, ``value``: each row as JSON with its fields in order of name; nulls are kept."""
    return rows.select(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}).alias("value"))


def write_json(rows: DataFrame, path: str, order: list | None = None) -> None:
    """Canonical JSON lines; with ``order`` the files follow that order. The commit protocol makes it all or nothing."""
    ordered = rows.orderBy(*order) if order else rows
    canonical_json(ordered).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """A fixed projection with a header."""
    rows.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_state(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """Replaces a state table."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def markdown(rows: DataFrame, order: list, limit: int, columns: list[str]) -> str:
    """A table of the first ``limit`` rows; only these reach the driver."""
    cell = lambda x: str("" if x is None else x).replace("|", "\\|").replace("\n", " ")
    found = rows.orderBy(*order).limit(limit).select(*columns).collect()
    head = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(head + ["| " + " | ".join(map(cell, r)) + " |" for r in found])


def publish_plan(files: DataFrame, run: str, latest: list[str]) -> DataFrame:
    """(source, target): every file goes under ``runs/<run>/``, and those named in ``latest`` under ``latest/`` too."""
    base = F.concat(F.lit(f"runs/{run}/"), F.col("name"))
    targets = F.when(F.col("name").isin(latest), F.array(base, F.concat(F.lit("latest/"), F.col("name")))).otherwise(F.array(base))
    return files.select(F.col("name").alias("source"), F.explode(targets).alias("target"))


def file_hashes(spark, path: str) -> DataFrame:
    """(path, sha256, length) of files, by which an artifact can be verified later."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length")


def verify(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, problem): files that are missing, extra or changed."""
    f = found.select("path", F.col("sha256").alias("now"))
    e = expected.select("path", F.col("sha256").alias("then"))
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "extra").when(F.col("now") != F.col("then"), "changed")
    return e.join(f, "path", "full_outer").select("path", problem.alias("problem")).where("problem IS NOT NULL")
