"""The streaming chain: parse, dedup, raw table; raw table, watermark, rollup; rollup, top-K tables.

Two queries share a durable raw table: the raw side keeps late rows, and the deduplication runs once for both.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ordertide.functions.scalar import dollar_text, padded
from ordertide.operators.parse import keyed_json, parse_json, to_raw
from ordertide.operators.rollup import rollup
from ordertide.operators.topk import running_revenue, top_k_global, top_k_per_restaurant
from ordertide.plans.serving import Serving
from ordertide.plans.store import Store
from ordertide.streaming.stateful import dedup_timer, dedup_ttl, dedup_within, open_walls, wall_windows

LATENESS = "10 seconds"
#: Tables that have topics.
SERVED = {"rollup", "restaurant_topk", "global_topk"}
#: Writes rows of key and value to a topic.
Send = Callable[[DataFrame], None]


def raw_events(values: DataFrame, *, key: str = "event_id", retention_ms: int | None = 3_600_000, clock: str = "processing", on_bad_record: str = "skip") -> DataFrame:
    """Typed, deduplicated raw rows of a stream of JSON values. With ``key`` order_id, later lines of an order go as well.

    ``retention_ms`` None keeps every key ever seen, which suits bounded replays: it ends by itself under availableNow. Else a key is
    kept for so long after its first row: by ``clock`` "processing", from when that row was processed, late rows included; by "event", until the
    events' own time has passed it by as much, where rows later than that are dropped. The latter stays in the JVM.
    """
    if clock not in ("processing", "event"):
        raise ValueError(clock)
    events = parse_json(values, on_bad_record=on_bad_record).observe("events", F.count(F.lit(1)).alias("n"))
    if retention_ms is None:
        unique = events.dropDuplicates([key])
    else:
        unique = dedup_ttl(events, key, retention_ms) if clock == "processing" else dedup_within(events, key, retention_ms)
    return to_raw(unique.observe("unique", F.count(F.lit(1)).alias("n")))


def rollup_stream(raw: DataFrame, size: str = "1 minute", lateness: str = LATENESS, *, clock: str = "event") -> DataFrame:
    """The watermark comes after the dedup, so a row is late only if its window has closed. ``clock`` "wall": windows by when a batch is processed, whatever the events say."""
    if clock not in ("event", "wall"):
        raise ValueError(clock)
    at = F.timestamp_millis("timestamp") if clock == "event" else F.current_timestamp()
    timed = raw.withColumn("event_time", at).withWatermark("event_time", lateness)
    return rollup(timed, size)


def write_table(df: DataFrame, path: str, checkpoint: str, *, once: bool = False, every: str = "60 seconds", partition: str | None = None) -> StreamingQuery:
    """Exactly-once Parquet sink, from the checkpoint on."""
    w = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    w = w.partitionBy(partition) if partition else w
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def write_topk(rolled: DataFrame, path: str, checkpoint: str, *, k: int = 10, mode: str = "combined", once: bool = False, every: str = "60 seconds") -> StreamingQuery:
    """Ranks each closed window. A batch overwrites its own folder, so that replaying it changes nothing.

    A window's rows all come in one batch: append mode emits them when the watermark passes its end.
    """

    def rank(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read by both rankings
        try:
            top_k_per_restaurant(batch, k).write.mode("overwrite").parquet(f"{path}/per_restaurant/batch={batch_id}")
            top_k_global(batch, k, mode).write.mode("overwrite").parquet(f"{path}/global/batch={batch_id}")
        finally:
            batch.unpersist()

    w = rolled.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(rank)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def drain(q: StreamingQuery, timeout: int = 600) -> None:
    """Waits for a bounded run, and raises what stopped it."""
    if not q.awaitTermination(timeout):
        q.stop()
        raise TimeoutError(f"{q.name or q.id} is still running after {timeout} s")
    if q.exception():
        raise q.exception()


def stop_when_read(q: StreamingQuery, rows: int, timeout: float = 600) -> None:
    """Stops a query that goes on by itself, as those with timers do, once it has read so many rows and committed the batch of the last of them."""
    end, seen = time.monotonic() + timeout, {}
    try:
        while sum(seen.values()) < rows:
            if q.exception():
                raise q.exception()
            if time.monotonic() > end:
                raise TimeoutError(f"{q.name or q.id} has read {sum(seen.values())} of {rows} rows after {timeout} s")
            time.sleep(0.2)
            seen |= {p.batchId: p.numInputRows for p in q.recentProgress}  # progress comes after the commit; only the newest are held
    finally:
        q.stop()


def send_table(rows: DataFrame, key: str | None, send: Send, checkpoint: str, *, once: bool = False, every: str = "60 seconds") -> StreamingQuery:
    """Sends a stream's rows to a topic, as JSON with the key's bytes: each batch at least once."""
    w = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: send(keyed_json(batch, key)))
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def _closed(name: str, windows: DataFrame, k: int, mode: str) -> DataFrame:
    """What the topic of a served table gets of the windows that a batch closes: rollup rows without a key, rankings by item."""
    if name == "rollup":
        return keyed_json(windows, None)
    return keyed_json(top_k_per_restaurant(windows, k) if name == "restaurant_topk" else top_k_global(windows, k, mode), "menu_item_id")


def serve_topk(
    rolled: DataFrame, serving: Serving, checkpoint: str, *, mode: str = "combined", topics: Mapping[str, Send] | None = None, once: bool = False, every: str = "60 seconds"
) -> StreamingQuery:
    """Keeps the served tables: a batch's closed windows join the rollup, their sums the tree, and they alone are ranked, all in one commit.

    The commit names the query and its batch, so a batch that is replayed after a failure changes nothing. ``topics``: writers for any of
    rollup, restaurant_topk and global_topk. They get a batch before it is committed, so at least once; what they get is ranked within the
    batch, to which a windowed aggregation in append mode gives whole windows.
    """
    if odd := (topics or {}).keys() - SERVED:
        raise ValueError(f"no such served table: {sorted(odd)}")

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # the stored rows' dates are found in it before it is written
        try:
            if topics and not batch.isEmpty():
                for name, send in topics.items():
                    send(_closed(name, batch, serving.k, mode))
            serving.append(batch, batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint, batch_id, mode=mode)
        finally:
            batch.unpersist()

    w = rolled.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def keep(
    changes: DataFrame,
    store: Store,
    outputs: Mapping[str, Callable[[DataFrame], DataFrame]],
    checkpoint: str,
    *,
    sends: Sequence[tuple[Callable[[DataFrame], DataFrame], Send]] = (),
    once: bool = False,
    every: str = "60 seconds",
) -> StreamingQuery:
    """Puts each batch into several tables of a store, in one commit that names the query and the batch: replayed batches change nothing.

    ``sends``: pairs of what a batch sends (``keyed_json`` rows) and a writer of it, for topics. They go before the commit, so a topic gets
    each batch at least once.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        writer = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        txn = store.begin(spark)
        if txn.done(writer, batch_id):
            return
        batch.persist()  # its state is computed once for all outputs
        try:
            if batch.isEmpty():
                return
            for of, send in sends:
                send(of(batch))
            for name, of in outputs.items():
                txn.put(name, of(batch))
            folded = [d for name in outputs for d in txn.fold(name)]
            txn.commit(writer, batch_id)
            if folded:
                store.vacuum(spark)
        finally:
            batch.unpersist()

    w = changes.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def chain(
    spark: SparkSession, values: DataFrame, serving: Serving, at: str, *, key: str = "event_id", retention_ms: int | None = 3_600_000, by_event_time: bool = False,
    size: str = "1 minute", lateness: str = LATENESS, mode: str = "combined", topics: Mapping[str, Send] | None = None, once: bool = False, every: str = "60 seconds",
) -> list[StreamingQuery]:
    """From a stream of JSON values to the tables that requests read: parse, dedup by ``key``, raw table; windows, rollup, tree and rankings.

    ``by_event_time``: the retention counts from event times, with timers, and not from when a row is processed. With ``once`` what is there is
    worked off and the queries have ended; windows that no later event has closed stay open in state. ``topics``: those of ``serve_topk``, and
    raw, which gets the raw table's rows by event, from the table itself, so that the deduplication isn't run again.
    """
    topics = dict(topics or {})
    send_raw = topics.pop("raw", None)
    if by_event_time:
        rows = to_raw(dedup_timer(parse_json(values, on_bad_record="skip"), key, retention_ms or 3_600_000, lateness).drop("event_time"))
    else:
        rows = raw_events(values, key=key, retention_ms=retention_ms)
    first = write_table(rows, f"{at}/raw", f"{at}/ck/raw", once=once, every=every)
    if once:
        drain(first)
    raw = spark.readStream.schema(rows.schema).parquet(f"{at}/raw")
    second = serve_topk(rollup_stream(raw, size, lateness), serving, f"{at}/ck/served", mode=mode, topics=topics, once=once, every=every)
    queries = [first, second]
    if send_raw:
        queries.append(send_table(raw, "event_id", send_raw, f"{at}/ck/raw_topic", once=once, every=every))
    if once:
        for q in queries[1:]:
            drain(q)
    return queries


def rank_walls(sums: DataFrame, store: Store, checkpoint: str, *, size_ms: int = 60_000, k: int = 10, mode: str = "combined", every: str = "1 second", outputs: tuple[str, str] = ("per_restaurant", "overall")) -> StreamingQuery:
    """Ranks tumbling windows of the wall clock as they end, whether or not anything comes in then, into two tables of kind ``latest``."""

    of = {outputs[0]: lambda b: top_k_per_restaurant(b, k), outputs[1]: lambda b: top_k_global(b, k, mode)}
    return keep(wall_windows(sums, size_ms), store, of, checkpoint, every=every)


def flush_walls(spark: SparkSession, store: Store, checkpoint: str, *, k: int = 10, mode: str = "combined", outputs: tuple[str, str] = ("per_restaurant", "overall")) -> int:
    """After a stop: ranks what the windows that were open then hold, read from the query's state; the number of their rows.

    The state stays as it is. If the query starts again before a window has ended, the window comes out whole, in place of this part of it.
    """
    open_ = open_walls(spark, checkpoint).cache()
    try:
        n = open_.count()
        if n:
            txn = store.begin(spark)
            txn.put(outputs[0], top_k_per_restaurant(open_, k))
            txn.put(outputs[1], top_k_global(open_, k, mode))
            txn.commit()
        return n
    finally:
        open_.unpersist()


@dataclass
class Counters:
    """Of one query: rows it read, records that didn't parse, rows that went on, repeats, late rows, and keys that it holds."""

    batches: int = 0
    rows: int = 0
    bad: int = 0
    unique: int = 0
    duplicates: int = 0
    late: int = 0
    state_rows: int = 0


class Progress(StreamingQueryListener):
    """Counters as each batch ends, a set for each query (its id stays over restarts), and a report every so many seconds.

    A query that ``raw_events`` made is counted by what it observes before and after the deduplication, whichever that is: state of one's own
    tells Spark nothing of repeats. Others are counted by their operators' metrics.
    """

    def __init__(self, every: float = 30, out: Callable[[str], None] | None = None) -> None:
        self.of: dict[str, Counters] = {}
        self.every, self.out, self._last = every, out or logging.getLogger(__name__).info, time.monotonic()

    def total(self) -> Counters:
        return Counters(*(sum(getattr(c, f.name) for c in list(self.of.values())) for f in fields(Counters)))

    def report(self) -> str:
        c = self.total()
        return f"{c.batches} batches, {c.rows} rows in, {c.bad} bad, {c.unique} went on, {c.duplicates} duplicates, {c.late} late, {c.state_rows} keys in state"

    def _tell(self) -> None:
        if time.monotonic() - self._last >= self.every:
            self._last = time.monotonic()
            self.out(self.report())

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        c = self.of.setdefault(str(p.id), Counters())
        states, seen = p.stateOperators, p.observedMetrics or {}
        c.rows += p.numInputRows
        c.batches += 1
        c.state_rows = sum(s.numRowsTotal for s in states)
        c.late += sum(s.numRowsDroppedByWatermark for s in states)
        if "events" in seen and "unique" in seen:
            parsed, unique = seen["events"]["n"] or 0, seen["unique"]["n"] or 0
            c.bad += max(p.numInputRows - parsed, 0)
            c.unique += unique
            c.duplicates += parsed - unique - sum(s.numRowsDroppedByWatermark for s in states)
        else:
            c.duplicates += sum(int((s.customMetrics or {}).get("numDroppedDuplicateRows", 0)) for s in states)
        self._tell()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._tell()

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def replay_rollup(spark: SparkSession, events: DataFrame, at: str, size: str = "1 minute", files: int = 4) -> DataFrame:
    """Runs the chain over bounded events, through JSON files in time order, and returns the rollup table with no window left open.

    A last event far ahead in time closes the windows; its own is never emitted.
    """
    end = events.agg(F.max("timestamp")).first()[0] or 0
    closing = spark.createDataFrame([("_closing", "_o", "_c", "_r", "_i", "_k", "_n", 0, 0, int(end) + 30 * 86_400_000)], events.select(*events.columns).schema)
    last = int(end) + 15 * 86_400_000
    keyed_json(events, None).select("value").write.text(f"{at}/in/a")
    keyed_json(closing, None).select("value").coalesce(1).write.text(f"{at}/in/b")
    values = spark.readStream.format("text").load(f"{at}/in/*")
    drain(write_table(raw_events(values, retention_ms=None), f"{at}/raw", f"{at}/ck/raw", once=True))
    raw_schema = spark.read.parquet(f"{at}/raw").schema
    raw = spark.readStream.schema(raw_schema).parquet(f"{at}/raw")
    drain(write_table(rollup_stream(raw, size), f"{at}/rollup", f"{at}/ck/rollup", once=True))
    return spark.read.parquet(f"{at}/rollup").where(F.col("window_start_1m") < last)


def replay_dedup(spark: SparkSession, events: DataFrame, at: str, key: str = "order_id", ttl_ms: int = 3_600_000, files: int = 4) -> DataFrame:
    """Runs the deduplication with timers over bounded events, so many ranges of time one after the other, each a micro-batch."""
    ends = events.approxQuantile("timestamp", [i / files for i in range(1, files)], 0.01) if files > 1 else []
    for i, (low, high) in enumerate(zip([None, *ends], [*ends, None], strict=True)):
        some = events if low is None else events.where(F.col("timestamp") >= low)
        some = some if high is None else some.where(F.col("timestamp") < high)
        keyed_json(some, None).select("value").write.text(f"{at}/in/{i}")
        kept = dedup_timer(parse_json(spark.readStream.text(f"{at}/in/*"), on_bad_record="skip"), key, ttl_ms)
        drain(write_table(kept.drop("event_time"), f"{at}/kept", f"{at}/ck", once=True))
    return spark.read.parquet(f"{at}/kept")


def console_report(events: DataFrame, checkpoint: str, *, k: int = 10, width: int = 24, out: Callable[[str], None] = print, once: bool = False, every: str = "10 seconds") -> StreamingQuery:
    """Prints the items of greatest revenue so far, after each batch that brings something: names padded, dollars to the right.

    Revenue is added up in the state of a JVM aggregate, and the K rows of the report come to the driver.
    """

    def tell(batch: DataFrame, batch_id: int) -> None:
        top = batch.orderBy(F.col("total_revenue").desc(), "menu_item_id").limit(k)
        rows = top.select(padded(F.coalesce("menu_item_name", F.lit("")), width).alias("item"), padded(dollar_text(F.col("total_revenue")), 14, left=True).alias("revenue")).collect()
        if rows:
            out("\n".join([f"top {k} by revenue, batch {batch_id}", *(f"{i + 1:>3}. {r.item} {r.revenue}" for i, r in enumerate(rows))]))

    w = running_revenue(events).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(tell)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()
