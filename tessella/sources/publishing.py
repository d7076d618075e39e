"""Publishing runs: files first, then a manifest, then the pointer to the latest run.

``df.write.format("publish").option("base", ..).option("run", ..).mode("append").save()`` writes each task's rows as a part of the run.
Only the driver's commit, after all tasks, writes the manifest that names the parts, and only then moves the pointer; a
failed job removes its run and leaves the pointer as it was.  Parts of lost or repeated attempts are in no manifest.  A run that has
a manifest is never written again.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

#: As ``functions.identity.path_safe`` has it.
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}\Z")
POINTER, MANIFEST = "latest.json", "manifest.json"


def store_of(base: str):
    """The file system of ``base`` and the path in it."""
    found, path = fs.FileSystem.from_uri(base) if "://" in base else (fs.LocalFileSystem(), base.removeprefix("file:"))
    return found, path.rstrip("/")


def put_small(store, path: str, content: dict) -> None:
    """A small file, whole or not at all."""
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(json.dumps(content, sort_keys=True).encode())
    store.move(part, path)


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int
    sha256: str


class PublishSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "publish"

    def writer(self, schema, overwrite) -> DataSourceArrowWriter:
        return _Publisher(self.options["base"], self.options["run"], schema)


class _Publisher(DataSourceArrowWriter):
    def __init__(self, base: str, run: str, schema):
        if not _NAME.match(run) or ".." in run:
            raise ValueError(f"not a name for a run: {run!r}")
        self.base, self.run, self.schema = base, run, to_arrow_schema(schema)
        store, root = store_of(base)
        if store.get_file_info(f"{root}/runs/{run}/{MANIFEST}").type != fs.FileType.NotFound:
            raise ValueError(f"run {run} is published already")

    def write(self, iterator) -> Part:
        store, root = store_of(self.base)
        folder, name, rows = f"{root}/runs/{self.run}", f"part-{uuid.uuid4().hex}.parquet", 0
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{name}") as raw, pq.ParquetWriter(raw, self.schema) as out:
            for batch in iterator:
                out.write_batch(batch.cast(self.schema) if batch.schema != self.schema else batch)
                rows += batch.num_rows
        digest = hashlib.sha256()
        with store.open_input_stream(f"{folder}/{name}") as back:
            while block := back.read(1 << 20):
                digest.update(block)
        return Part(name, rows, digest.hexdigest())

    def commit(self, messages) -> None:
        store, root = store_of(self.base)
        folder = f"{root}/runs/{self.run}"
        store.create_dir(folder, recursive=True)
        parts = sorted((m for m in messages if m), key=lambda m: m.name)
        put_small(store, f"{folder}/{MANIFEST}", {"run": self.run, "rows": sum(p.rows for p in parts), "parts": [{"name": p.name, "rows": p.rows, "sha256": p.sha256} for p in parts]})
        put_small(store, f"{root}/{POINTER}", {"run": self.run})

    def abort(self, messages) -> None:
        store, root = store_of(self.base)
        folder = f"{root}/runs/{self.run}"
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


def publish(rows: DataFrame, base: str, run: str) -> None:
    """Publishes ``rows`` as ``run``; see the module."""
    rows.sparkSession.dataSource.register(PublishSink)
    rows.write.format("publish").option("base", base).option("run", run).mode("append").save()


def latest_run(spark: SparkSession, base: str) -> str | None:
    """The run that the pointer names."""
    store, root = store_of(base)
    if store.get_file_info(f"{root}/{POINTER}").type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{root}/{POINTER}") as f:
        return json.loads(f.read())["run"]


def published(spark: SparkSession, base: str, run: str | None = None) -> DataFrame:
    """Rows of ``run``, or of the latest one: the parts that its manifest names."""
    run = run or latest_run(spark, base)
    store, root = store_of(base)
    with store.open_input_stream(f"{root}/runs/{run}/{MANIFEST}") as f:
        parts = json.loads(f.read())["parts"]
    return spark.read.parquet(*[f"{base.rstrip('/')}/runs/{run}/{p['name']}" for p in parts])


def damaged(spark: SparkSession, base: str, run: str) -> DataFrame:
    """(name, problem): parts of ``run`` that are missing or changed; their content is hashed in executors."""
    store, root = store_of(base)
    with store.open_input_stream(f"{root}/runs/{run}/{MANIFEST}") as f:
        parts = [(p["name"], p["sha256"]) for p in json.loads(f.read())["parts"]]

    def run_(batches):
        here, top = store_of(base)
        for batch in batches:
            problems = []
            for name, sha in zip(*(c.to_pylist() for c in batch.columns)):
                digest, path = hashlib.sha256(), f"{top}/runs/{run}/{name}"
                if here.get_file_info(path).type == fs.FileType.NotFound:
                    problems.append("missing")
                    continue
                with here.open_input_stream(path) as back:
                    while block := back.read(1 << 20):
                        digest.update(block)
                problems.append(None if digest.hexdigest() == sha else "changed")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(problems, pa.string())], ["name", "problem"])

    listed = spark.createDataFrame(parts, "name string, sha256 string")
    return listed.mapInArrow(run_, "name string, problem string").where("problem IS NOT NULL")


# --- observed writes ------------------------------------------------------------------------------


def write_observed(rows: DataFrame, path: str, measures: dict[str, Column], mode: str = "overwrite") -> dict:
    """Writes ``rows`` as Parquet and returns aggregates of them that the same job has collected; rows are read once."""
    seen = Observation()
    rows.observe(seen, *[m.alias(name) for name, m in measures.items()]).write.mode(mode).parquet(path)
    return seen.get


def health(spark: SparkSession, stages: list[tuple[str, dict]], limits: list[tuple[str, str, str, float]]) -> DataFrame:
    """(stage, metric, value, problem) of observed stages.

    ``limits``: (stage, metric, ``least`` or ``most``, bound); a metric beyond its bound, or one that is not there, is a problem.
    """
    values = {(stage, metric): value for stage, found in stages for metric, value in found.items()}
    rows = []
    for stage, metric in dict.fromkeys([*values, *[(s, m) for s, m, *_ in limits]]):
        value, problems = values.get((stage, metric)), []
        for s, m, kind, bound in limits:
            if (s, m) == (stage, metric):
                wrong = value is None or value < bound if kind == "least" else value is None or value > bound
                if wrong:
                    problems.append("not observed" if value is None else f"{kind} {bound:g}")
        rows.append((stage, metric, None if value is None else float(value), "; ".join(problems) or None))
    return spark.createDataFrame(rows, "stage string, metric string, value double, problem string")


def summary(found: DataFrame) -> DataFrame:
    """One row a stage: how many metrics, how many problems, and ``ok`` or ``failed``."""
    return found.groupBy("stage").agg(
        F.count("*").alias("metrics"), F.count("problem").alias("problems"), F.when(F.count("problem") > 0, "failed").otherwise("ok").alias("status")
    )


# --- the registry of runs -------------------------------------------------------------------------

INDEX = "owner string, run string, at timestamp, rows long, complete boolean"


def scan_runs(spark: SparkSession, base: str) -> DataFrame:
    """The index as the files have it: one JSON record a run, in ``runs/owner=<owner>/run=<run>``."""
    found = spark.read.schema("at timestamp, rows long, complete boolean, owner string, run string").option("basePath", f"{base}/runs").json(f"{base}/runs")
    return found.select(*[c.split()[0] for c in INDEX.split(", ")])


def write_index(runs: DataFrame, base: str) -> None:
    """Replaces the index of the owners that ``runs`` has, and no others'."""
    runs.select("run", "at", "rows", "complete", "owner").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("owner").parquet(f"{base}/index")


def read_index(spark: SparkSession, base: str) -> tuple[DataFrame, str]:
    """The index, and whether it was ``read`` or, being missing or damaged, was ``rebuilt`` from the files and written anew."""
    try:
        found = spark.read.schema("run string, at timestamp, rows long, complete boolean, owner string").parquet(f"{base}/index")
        found.agg(F.count("run"), F.max("at"), F.sum("rows"), F.bool_and("complete")).collect()  # reads every column, so damage shows here
        return found.select(*[c.split()[0] for c in INDEX.split(", ")]), "read"
    except (PySparkException, Py4JJavaError):  # not every fault of the JVM has a class of its own
        found = scan_runs(spark, base)
        store, root = store_of(base)
        if store.get_file_info(f"{root}/index").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/index")
        write_index(found, base)
        return found, "rebuilt"


def resolve(index: DataFrame, pointers: DataFrame) -> DataFrame:
    """(owner, run, found_by) of every owner: the run that its pointer names, if the index has it, else the latest complete run, else none."""
    named = pointers.select("owner", F.col("run").alias("pointed"))
    runs = index.join(named, "owner", "left")
    order = F.struct("at", "run")
    found = runs.groupBy("owner").agg(
        F.max(F.when(F.col("run") == F.col("pointed"), F.col("run"))).alias("pointed"), F.max_by("run", F.when(F.col("complete"), order)).alias("complete")
    )
    by = F.when(F.col("pointed").isNotNull(), "pointer").when(F.col("complete").isNotNull(), "complete").otherwise("none")
    return found.select("owner", F.coalesce("pointed", "complete").alias("run"), by.alias("found_by"))
