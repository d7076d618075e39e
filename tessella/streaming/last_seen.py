"""Alerts over a stream, against the last-seen state of each key; failures in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .keyed_state import keyed_store, last_seen


def follow(stream: DataFrame, key: str, ts: str, score: str, content: str, threshold: int, alerts_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Writes the alerts of every batch against the keyed state before it; a batch touches only its own keys.

    Alerts are written under the batch's number, so a batch that runs again after a failure writes the same
    folder anew and nothing twice.  Keys that a batch doesn't have are not removed.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch.drop("at").write.mode("overwrite").parquet(f"{alerts_path}/batch={number}")

    alerts = last_seen(stream, key, ts, score, content, threshold)
    with keyed_store(stream.sparkSession):
        writer = alerts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def failing_users(stream: DataFrame, key: str, ts: str, failed, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Failures by key in tumbling windows; rows later than ``delay`` are dropped by the watermark."""
    marked = stream.withWatermark(ts, delay)
    return marked.groupBy(F.window(ts, window).alias("w"), key).agg(F.count_if(failed).alias("failures"), F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), key, "failures", "n"
    )
