"""State by key over a stream: what was last seen of a key, and how its rank moved.

Every key's state lives in the state store of the partition that the key is dealt to.  A batch reads and writes
only the keys that it has; timers and time to live end what is no longer wanted.  The checkpoint holds
the state's changes, so a query that starts again goes on where it stopped, and a batch that runs twice counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_store(spark: SparkSession):
    """Queries that start inside keep their keyed state in RocksDB: on disk, not in the executors' heaps."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def thinned(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with only the last by ``order`` of each key in every Arrow batch, before they are shuffled.

    A key with a large part of all rows then sends one row a batch to its partition.  Nulls come first.
    """
    schema = rows.schema

    def run(batches):
        for batch in batches:
            t = batch.to_pandas()
            keep = t.assign(_at=range(len(t))).sort_values(order, kind="stable", na_position="first").drop_duplicates(key, keep="last")["_at"]
            yield batch.take(pa.array(sorted(keep.tolist())))

    return rows.mapInArrow(run, schema)


def _order(values):
    return [(v is not None, v) for v in values]


class LastSeen(StatefulProcessor):
    """Alerts of keys: new, gone, a score that moved by ``threshold`` or more, other content.

    With ``gone_ms`` a key that is not seen for so long in event time is forgotten, with an alert at the time it expired.
    """

    def __init__(self, key: str, score: str, content: str, threshold: int, kinds: dict[str, str], gone_ms: int | None = None):
        self.names, self.threshold, self.gone_ms, self.kinds = (key, "_us", score, content), threshold, gone_ms, kinds

    def init(self, handle) -> None:
        self.handle = handle
        _, *rest = self.names
        self.last = handle.getValueState("last", ", ".join(f"`{c}` {self.kinds[c]}" for c in rest))

    def _alert(self, key, kind, at, delta=None) -> Row:
        return Row(**{self.names[0]: key, "kind": kind, "at": at, "score_delta": delta})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        _, *rest = self.names
        new = None
        for r in rows:
            values = tuple(r[c] for c in rest)
            if new is None or _order(values) > _order(new):
                new = values
        at, score, content = new
        before = self.last.get() if self.last.exists() else None
        if before is None:
            yield self._alert(key[0], "new", at)
        else:
            then, old_score, old_content = before
            if _order(new) < _order((then, old_score, old_content)):
                new = (then, old_score, old_content)  # an older row than the state's changes nothing that is kept
            moved = score - old_score if score is not None and old_score is not None else None
            if moved is not None and abs(moved) >= self.threshold:
                yield self._alert(key[0], "score", at, moved)
            if content is not None and old_content is not None and content != old_content:
                yield self._alert(key[0], "content", at)
        self.last.update(new)
        if self.gone_ms is not None and new[0] is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(new[0] // 1000 + self.gone_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            at = self.last.get()[0]
            self.last.clear()
            yield self._alert(key[0], "gone", at)

    def close(self) -> None:
        pass


class RankMoves(StatefulProcessor):
    """A row for every key of a run: its rank, the rank it had when it was last ranked, and the move (up is positive).

    ``ttl_ms`` forgets keys that no run had for so long.
    """

    def __init__(self, key: str, run: str, rank: str, kinds: dict[str, str], ttl_ms: int | None = None):
        self.names, self.kinds, self.ttl_ms = (key, run, rank), kinds, ttl_ms

    def init(self, handle) -> None:
        _, run, rank = self.names
        self.last = handle.getValueState("ranked", f"`{run}` {self.kinds[run]}, `{rank}` {self.kinds[rank]}", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        k, run, rank = self.names
        before = self.last.get() if self.last.exists() else None
        for at, now in sorted(((r[run], r[rank]) for r in rows), key=_order):
            if before is not None and _order([at]) <= _order([before[0]]):
                continue  # a run that was taken before, or an older one
            old = before[1] if before is not None else None
            yield Row(**{k: key[0], run: at, rank: now, f"previous_{rank}": old, "move": None if old is None else old - now})
            before = (at, now)
        if before is not None:
            self.last.update(before)

    def close(self) -> None:
        pass


def last_seen(stream: DataFrame, key: str, ts: str, score: str, content: str, threshold: int, gone_ms: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """The stream of alerts (key, kind, at, score_delta); see ``LastSeen``."""
    us = F.unix_micros(F.col(ts).cast("timestamp")).alias("_us")
    rows = thinned(stream.select(key, F.col(ts).alias("_ts"), us, score, content), key, ["_us", score, content])
    kinds = dict(rows.dtypes)
    if gone_ms is not None:
        rows = rows.withWatermark("_ts", delay)
    schema = f"`{key}` {kinds[key]}, kind string, at long, score_delta {kinds[score]}"
    processor = LastSeen(key, score, content, threshold, kinds, gone_ms)
    alerts = rows.groupBy(key).transformWithState(processor, schema, "Append", "EventTime" if gone_ms is not None else "None")
    return alerts.withColumn("at", F.timestamp_micros("at"))


def rank_moves(stream: DataFrame, key: str, run: str, rank: str, ttl_ms: int | None = None) -> DataFrame:
    """The stream of (key, run, rank, previous_rank, move); see ``RankMoves``."""
    kinds = dict(stream.dtypes)
    schema = f"`{key}` {kinds[key]}, `{run}` {kinds[run]}, `{rank}` {kinds[rank]}, `previous_{rank}` {kinds[rank]}, move {kinds[rank]}"
    return stream.select(key, run, rank).groupBy(key).transformWithState(RankMoves(key, run, rank, kinds, ttl_ms), schema, "Append", "ProcessingTime" if ttl_ms else "None")


def append(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Starts writing ``stream`` to Parquet files; their log and the checkpoint make each row come once."""
    with keyed_store(stream.sparkSession):
        writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
