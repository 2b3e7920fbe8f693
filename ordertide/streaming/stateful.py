"""Keyed state: deduplication by retention in processing time or event time, and windows of the wall clock."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ordertide.session import with_state


class KeepFirstTtl(StatefulProcessor):
    """The first row of a key; its state goes ``ttl_ms`` of processing time after that row. Repeats don't refresh it."""

    def __init__(self, ttl_ms: int = 3_600_000):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("seen", T.BooleanType())]), ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:  # noqa: N802, N803
        first = next(iter(rows), None)
        if first is not None and not self.seen.exists():
            self.seen.update((True,))
            yield first
        for _ in rows:
            pass

    def close(self) -> None:
        pass


#: Groups of keys, by hash, that ``KeepFirstWithin`` keeps together.
GROUPS = 1024
_HELD = T.StructType([T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("at", T.ArrayType(T.LongType()))])


class KeepFirstWithin:
    """Rows of a key that no accepted row precedes by less than ``ttl_ms`` of event time. A group holds many keys, with the time of the last row accepted.

    The rows' own times decide, so that the result doesn't depend on where batches end; when the watermark has passed a key's retention it is
    forgotten, at the group's next rows or by a timer, which only frees memory. Keys come in groups, as a call of Python for each key costs far more than its rows.
    """

    def __init__(self, key: str, ttl_ms: int = 3_600_000):
        self.key, self.ttl_ms = key, ttl_ms

    def __call__(self, group: tuple, parts: Iterator, state: GroupState) -> Iterator:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        if not state.hasTimedOut:
            rows = pd.concat(list(parts), ignore_index=True)
            order = rows.assign(event_id=rows["event_id"].fillna("")).sort_values(["timestamp", "event_id"], kind="stable").index
            kept = []
            for i, k, t in zip(order, rows[self.key].to_numpy()[order], rows["timestamp"].to_numpy()[order].tolist(), strict=True):
                if k not in held or t >= held[k] + self.ttl_ms:
                    held[k] = t
                    kept.append(i)
            if kept:
                yield rows.iloc[kept].drop(columns="_group")
        now = state.getCurrentWatermarkMs()
        held = {k: t for k, t in held.items() if t + self.ttl_ms > now}
        if held:
            state.update((list(held), list(held.values())))
            state.setTimeoutTimestamp(min(held.values()) + self.ttl_ms)
        elif state.exists:
            state.remove()


def dedup_ttl(events: DataFrame, key: str = "event_id", ttl_ms: int = 3_600_000) -> DataFrame:
    """On a stream without a watermark; late rows stay for the raw table."""
    with_state(events.sparkSession)
    return events.where(F.col(key).isNotNull()).groupBy(key).transformWithState(KeepFirstTtl(ttl_ms), events.schema, "append", "processingTime")


def dedup_timer(events: DataFrame, key: str = "order_id", ttl_ms: int = 3_600_000, lateness: str = "10 seconds") -> DataFrame:
    """Adds ``event_time`` with a watermark, which the timers need."""
    timed = events.where(F.col(key).isNotNull() & F.col("timestamp").isNotNull()).withColumn("event_time", F.timestamp_millis("timestamp")).withWatermark("event_time", lateness)
    groups = timed.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(GROUPS))).groupBy("_group")
    return groups.applyInPandasWithState(KeepFirstWithin(key, ttl_ms), timed.schema, _HELD, "append", GroupStateTimeout.EventTimeTimeout)


def dedup_within(events: DataFrame, key: str = "event_id", retention_ms: int = 3_600_000) -> DataFrame:
    """The first row of a key, which is known until the watermark, ``retention_ms`` behind the events, has passed that row by as much again. Rows behind the watermark go."""
    timed = events.where(F.col(key).isNotNull()).withColumn("event_time", F.timestamp_millis("timestamp")).withWatermark("event_time", f"{retention_ms} milliseconds")
    return timed.dropDuplicatesWithinWatermark([key]).drop("event_time")


# Fixed names: columns of a rollup that rankings need.
_WALL = "restaurant_id string, menu_item_id string, menu_item_name string, order_count bigint, sum_quantity bigint, sum_revenue_cents bigint, window_start_1m bigint, window_end bigint"
_COLUMNS = [f.split()[0] for f in _WALL.split(", ")]
_SUMS = T.StructType([T.StructField(n, T.StringType() if t == "string" else T.LongType()) for n, t in (f.split() for f in _WALL.split(", "))])


class WallWindow(StatefulProcessor):
    """Sums of one restaurant's item since its window of the wall clock began. A timer sends them out when the window ends."""

    def __init__(self, size_ms: int):
        self.size_ms = size_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", _SUMS)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:  # noqa: N802, N803
        start = timerValues.getCurrentProcessingTimeInMs() // self.size_ms * self.size_ms
        held = tuple(self.sums.get()) if self.sums.exists() else None
        if held and held[6] < start:  # its timer fires in this batch, after the rows
            yield Row(*_COLUMNS)(*held)
            self.handle.deleteTimer(held[7])
            held = None
        if held is None:
            held = (key[0], key[1], None, 0, 0, 0, start, start + self.size_ms)
            self.handle.registerTimer(start + self.size_ms)
        for r in rows:
            held = (*held[:2], r["menu_item_name"], held[3] + r["order_count"], held[4] + r["sum_quantity"], held[5] + r["sum_revenue_cents"], *held[6:])
        self.sums.update(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        if self.sums.exists() and self.sums.get()[7] <= expiredTimerInfo.getExpiryTimeInMs():
            yield Row(*_COLUMNS)(*self.sums.get())
            self.sums.clear()

    def close(self) -> None:
        pass


def wall_windows(sums: DataFrame, size_ms: int = 60_000) -> DataFrame:
    """Rollup rows of tumbling windows by when partial sums (of ``ranking.combined``) are processed, whatever the events say. A window comes out when the clock passes its end, without further input."""
    with_state(sums.sparkSession)
    return sums.groupBy("restaurant_id", "menu_item_id").transformWithState(WallWindow(size_ms), _WALL, "append", "processingTime")


def open_walls(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What the windows hold that are open in a stopped query's state."""
    state = spark.read.format("statestore").option("stateVarName", "sums").load(checkpoint)
    return state.select("value.*").where("window_start_1m IS NOT NULL").select(*_COLUMNS)
