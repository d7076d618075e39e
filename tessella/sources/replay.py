"""Archived inputs and recalculation: a run's inputs are kept with their fingerprints, and its plan can be run on them again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.diff import content_fingerprint
from .publishing import fs, put_small, store_of

Plan = Callable[[dict[str, DataFrame]], DataFrame]


def signature(config) -> str:
    """SHA-256 of a configuration: keys in order, numbers at six places (half to even), so that 1 and 1.0 are the same."""

    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool):
            return f"{Decimal(str(x)).quantize(Decimal('0.000001'), ROUND_HALF_EVEN):f}"
        return x

    return hashlib.sha256(json.dumps(plain(config), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def fingerprint(rows: DataFrame) -> str:
    """A digest of whole rows, whatever their order."""
    whole = F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    return content_fingerprint(rows.select(F.sha2(whole, 256).alias("h")), "h").first()[0]


def archive(base: str, run: str, inputs: dict[str, DataFrame], plan: Plan, config) -> DataFrame:
    """Keeps ``inputs``, runs ``plan`` on what was kept, and records the fingerprints of all; gives the plan's rows.

    The record is written last: a run without one was not completed.
    """
    spark, folder = next(iter(inputs.values())).sparkSession, f"{base.rstrip('/')}/{run}"
    for name, rows in inputs.items():
        rows.write.mode("overwrite").parquet(f"{folder}/inputs/{name}")
    kept = {name: spark.read.parquet(f"{folder}/inputs/{name}") for name in inputs}
    plan(kept).write.mode("overwrite").parquet(f"{folder}/output")
    output = spark.read.parquet(f"{folder}/output")
    store, root = store_of(folder)
    put_small(store, f"{root}/record.json", {"config": signature(config), "inputs": {n: fingerprint(r) for n, r in kept.items()}, "output": fingerprint(output)})
    return output


def recalculate(spark: SparkSession, base: str, run: str, plan: Plan, config) -> DataFrame:
    """(what, name, problem): the archived inputs, the configuration, the output kept, and the output of ``plan`` run anew, against the record.

    A problem is ``changed``, or null where all is as it was.
    """
    folder = f"{base.rstrip('/')}/{run}"
    store, root = store_of(folder)
    if store.get_file_info(f"{root}/record.json").type == fs.FileType.NotFound:
        raise ValueError(f"run {run} has no record")
    with store.open_input_stream(f"{root}/record.json") as f:
        record = json.loads(f.read())
    kept = {name: spark.read.parquet(f"{folder}/inputs/{name}") for name in record["inputs"]}
    now = [("input", n, fingerprint(r), record["inputs"][n]) for n, r in kept.items()]
    now.append(("config", "", signature(config), record["config"]))
    now.append(("output", "kept", fingerprint(spark.read.parquet(f"{folder}/output")), record["output"]))
    now.append(("output", "recalculated", fingerprint(plan(kept)), record["output"]))
    return spark.createDataFrame([(w, n, None if a == b else "changed") for w, n, a, b in now], "what string, name string, problem string")
