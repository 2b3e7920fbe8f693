"""Rankings that are kept up as a stream goes on, in keyed state.

Counts only grow, so an item that isn't touched can't enter a top K: a batch reads and writes the items that it brings and the K
that stand, and nothing else. A ranking is made in two levels: items are dealt to salted keys by their hash, each of which passes on
those of its own K that a batch has changed, and one key merges K rows a salt at most. So no task holds a window.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ordertide.functions.scalar import event_time, window_floor
from ordertide.operators.topk import ALL
from ordertide.session import with_state

_ITEM = "restaurant_id string, menu_item_id string, menu_item_name string, named_at bigint, order_count bigint, total_quantity bigint, total_revenue_in_cents bigint, window_start bigint, window_end bigint"
_FIELDS = [f.split()[0] for f in _ITEM.split(", ")]
_SCHEMA = T.StructType([T.StructField(n, T.StringType() if t == "string" else T.LongType()) for n, t in (f.split() for f in _ITEM.split(", "))])
_KEPT = T.StructType([T.StructField("rows", T.ArrayType(_SCHEMA))])
#: Of a ranking that no window ends.
OPEN = -1
_PASSED = Row("period", "ranked_for", "event_time", *_FIELDS)
_RANKED = ["period", "ranked_for", "rank", "restaurant_id", "menu_item_id", "menu_item_name", "order_count", "total_quantity", "total_revenue_in_cents", "window_start", "window_end"]


def _place(row: tuple) -> tuple:
    """Greatest count first, then item and restaurant."""
    return (-row[4], row[1], row[0])


def _added(a: tuple, b: tuple) -> tuple:
    name = max((a[3], a[2]), (b[3], b[2]))
    return (*a[:2], name[1], name[0], a[4] + b[4], a[5] + b[5], a[6] + b[6], *a[7:])


def _better(a: tuple, b: tuple) -> tuple:
    """The window of greater count, of equals the earliest, then the last restaurant."""
    return max(a, b, key=lambda r: (r[4], -r[7], r[0] or ""))


class ItemTotals(StatefulProcessor):
    """All items of one salted key, and which K stand; passes on the standing items that a batch has changed."""

    def __init__(self, k: int, how: str):
        self.k, self.how = k, how

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", T.StructType([T.StructField("item", T.StringType())]), _SCHEMA)
        self.top = handle.getValueState("top", _KEPT)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:  # noqa: N802, N803
        merge, now, at = _added if self.how == "sum" else _better, {}, None
        for r in rows:
            row, at = tuple(r[f] for f in _FIELDS), r["event_time"]
            if row[1] in now:
                now[row[1]] = merge(now[row[1]], row)
            else:
                held = self.items.getValue((row[1],)) if self.items.containsKey((row[1],)) else None
                now[row[1]] = row if held is None else merge(tuple(held), row)
        first = not self.top.exists()
        stood = {} if first else {r[1]: tuple(r) for r in self.top.get()[0]}
        top = heapq.nsmallest(self.k, (stood | now).values(), key=_place)
        stands = {r[1] for r in top}
        for item, row in now.items():
            if self.how == "sum" or item in stands:  # of best windows those that stand: only a greater one yet could bring another back
                self.items.updateValue((item,), row)
        if self.how == "max":
            for item in stood.keys() - stands:
                self.items.removeKey((item,))
        self.top.update((top,))
        end = next(iter(now.values()))[8] if now else OPEN
        if first and self.how == "sum" and end != OPEN:
            self.handle.registerTimer(end)
        for row in top:
            if row[1] in now and stood.get(row[1]) != row:
                yield _PASSED(key[0], key[1], at, *row)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        self.items.clear()
        self.top.clear()
        return iter(())

    def close(self) -> None:
        pass


class Ranking(StatefulProcessor):
    """The K greatest of what the salted keys pass on; all K go out again when one has changed."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.top = handle.getValueState("top", _KEPT)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:  # noqa: N802, N803
        first = not self.top.exists()
        stood = [] if first else [tuple(r) for r in self.top.get()[0]]
        items = {r[1]: r for r in stood} | {r["menu_item_id"]: tuple(r[f] for f in _FIELDS) for r in rows}
        top = heapq.nsmallest(self.k, items.values(), key=_place)
        if top == stood:
            return
        self.top.update((top,))
        if first and key[0] != OPEN:
            self.handle.registerTimer(top[0][8])
        for i, row in enumerate(top):
            yield Row(*_RANKED)(key[0], key[1], i + 1, *(row[_FIELDS.index(c)] for c in _RANKED[3:]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        self.top.clear()
        return iter(())

    def close(self) -> None:
        pass


def combined(events: DataFrame, size_ms: int = 60_000) -> DataFrame:
    """A stream of events as partial sums by window, restaurant and item: each task adds its rows up before they are dealt out."""
    whole = "restaurant_id string, menu_item_id string, menu_item_name string, named_at bigint, order_count bigint, sum_quantity bigint, sum_revenue_cents bigint, window_start_1m bigint, window_end bigint"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b]).sort_by([("timestamp", "ascending"), ("event_id", "ascending")])
            g = t.group_by(["restaurant_id", "menu_item_id", "w"], use_threads=False).aggregate([("menu_item_name", "last"), ("timestamp", "max"), ("timestamp", "count"), ("q", "sum"), ("r", "sum")])
            at = g.column("w")
            out = [g.column(c) for c in ("restaurant_id", "menu_item_id", "menu_item_name_last", "timestamp_max", "timestamp_count", "q_sum", "r_sum")]
            yield from pa.table([*out, at, pa.compute.add(at, size_ms)], names=[f.split()[0] for f in whole.split(", ")]).to_batches()

    long = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint"))
    rows = events.where("timestamp IS NOT NULL AND menu_item_id IS NOT NULL").select(
        "restaurant_id", "menu_item_id", "menu_item_name", "timestamp", "event_id", window_floor(F.col("timestamp"), size_ms).alias("w"),
        long("quantity").alias("q"), (long("quantity") * long("price_in_cents")).alias("r"),
    )
    return rows.mapInArrow(add, whole)


def ranked_stream(sums: DataFrame, k: int = 10, *, overall: bool = False, how: str = "sum", lateness: str = "2 minutes", salts: int = 16) -> DataFrame:
    """Rankings as they change, from a stream of partial sums (of ``combined``, or rollup rows), for each window and restaurant, or for each window.

    ``how`` "sum" adds an item's rows up within their window; a window's state goes when the watermark passes its end, and rows of
    it that come later are dropped. Rows count as their window's end for the watermark, so ``lateness`` beyond a window's size keeps it open for
    rows out of order. ``how`` "max" ranks items by their best single window over all time, with no more than K a salt in state.

    Each row is a place: period (the window's start, or -1), ranked_for (restaurant, or ALL), rank and what stands there. A batch that
    changes a ranking sends all its places.
    """
    if how not in ("sum", "max"):
        raise ValueError(how)
    if k < 1:
        raise ValueError("k must be 1 or more")
    with_state(sums.sparkSession)
    named = F.col("named_at") if "named_at" in sums.columns else F.col("window_start_1m")
    period = F.col("window_start_1m") if how == "sum" else F.lit(OPEN).cast("bigint")
    rows = sums.select(
        period.alias("period"), (F.lit(ALL) if overall else F.col("restaurant_id")).alias("ranked_for"), F.pmod(F.xxhash64("menu_item_id"), F.lit(salts)).alias("salt"),
        event_time(F.col("window_end")).alias("event_time"), (F.lit(ALL) if overall and how == "sum" else F.col("restaurant_id")).alias("restaurant_id"), "menu_item_id", "menu_item_name",
        named.cast("bigint").alias("named_at"), "order_count", F.col("sum_quantity").alias("total_quantity"), F.col("sum_revenue_cents").alias("total_revenue_in_cents"),
        F.col("window_start_1m").alias("window_start"), "window_end",
    )
    if how == "sum":
        rows = rows.withWatermark("event_time", lateness)
    mode, timed = ("eventTime", "event_time") if how == "sum" else ("none", "")
    parts = rows.groupBy("period", "ranked_for", "salt").transformWithState(ItemTotals(k, how), f"period bigint, ranked_for string, event_time timestamp, {_ITEM}", "append", mode, eventTimeColumnName=timed)
    out = ", ".join(f"{c} {'string' if c in ('ranked_for', 'restaurant_id', 'menu_item_id', 'menu_item_name') else 'int' if c == 'rank' else 'bigint'}" for c in _RANKED)
    top = parts.groupBy("period", "ranked_for").transformWithState(Ranking(k), out, "append", mode)
    return top.withColumn("restaurant_id", F.lit(ALL)) if overall else top
