import json
import time

import pytest
from pyspark.sql import functions as F

from ordertide import session
from ordertide.operators.dedup import keep_first
from ordertide.operators.rollup import rollup
from ordertide.schemas import ORDER_EVENT
from ordertide.sources.generate import generate
from ordertide.operators.parse import parse_json
from ordertide.plans.store import Kept, Store
from ordertide.streaming.jobs import Progress, console_report, drain, flush_walls, rank_walls, raw_events, replay_dedup, replay_rollup, rollup_stream, write_table, write_topk
from ordertide.streaming.ranking import combined

T0 = 1704067200000


def _event(i, second, **kw):
    return {"event_id": str(i), "order_id": f"o{i}", "customer_id": "c", "restaurant_id": "R", "menu_item_id": "I", "category_id": "k", "menu_item_name": "n", "quantity": 1, "price_in_cents": 2, "timestamp": T0 + int(second * 1000)} | kw


def _feed(spark, path, batches):
    """Runs the chain with one file in each micro-batch; raw rows, and the windows' counts."""
    n, raw_schema = 0, None
    for k, seconds in enumerate(batches):
        (path / "in").mkdir(exist_ok=True)
        (path / "in" / f"{k}.json").write_text("".join(json.dumps(_event(n := n + 1, s)) + "\n" for s in seconds))
        drain(write_table(raw_events(spark.readStream.text(f"{path}/in"), retention_ms=None), f"{path}/raw", f"{path}/ck1", once=True))
        raw_schema = raw_schema or spark.read.parquet(f"{path}/raw").schema
        drain(write_table(rollup_stream(spark.readStream.schema(raw_schema).parquet(f"{path}/raw")), f"{path}/rollup", f"{path}/ck2", once=True))
    return spark.read.parquet(f"{path}/raw").count(), {(r.window_start_1m - T0) // 1000: r.order_count for r in spark.read.parquet(f"{path}/rollup").collect()}


def test_late_row_of_a_closed_window_is_dropped(spark, tmp_path):
    raw, windows = _feed(spark, tmp_path, [[1, 5], [65], [75], [76], [3], [200]])
    assert raw == 7 and windows[0] == 2


def test_row_of_an_open_window_counts(spark, tmp_path):
    assert _feed(spark, tmp_path, [[1], [69], [69.5], [58], [200]])[1][0] == 2


def test_replay_equals_batch(spark):
    events = generate(spark, 2000, gap_ms=500)
    twice = events.unionByName(events.limit(300))
    key = ["restaurant_id", "menu_item_id", "window_start_1m", "sum_quantity", "sum_revenue_cents", "order_count"]
    got = replay_rollup(spark, twice, session.fresh_path(spark, "t")).select(*key).collect()
    assert sorted(got) == sorted(rollup(keep_first(twice)).select(*key).collect())


def test_topk_sink_is_idempotent(spark, tmp_path):
    rollup(generate(spark, 600)).coalesce(1).write.parquet(f"{tmp_path}/r")
    schema = spark.read.parquet(f"{tmp_path}/r").schema
    for ck in ("a", "b"):
        drain(write_topk(spark.readStream.schema(schema).parquet(f"{tmp_path}/r"), f"{tmp_path}/top", f"{tmp_path}/{ck}", k=3, once=True))
    top = spark.read.parquet(f"{tmp_path}/top/per_restaurant")
    assert top.agg(F.max("rank")).first()[0] == 3 and top.groupBy("window_start", "restaurant_id", "rank").count().where("count > 1").count() == 0


def test_ttl_dedup(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("".join(json.dumps(_event(i % 3, i)) + "\n" for i in range(9)))
    q = write_table(raw_events(spark.readStream.text(f"{tmp_path}/in")), f"{tmp_path}/raw", f"{tmp_path}/ck", every="1 second")
    for _ in range(120):
        if q.recentProgress and any(p.numInputRows for p in q.recentProgress):
            break
        time.sleep(0.5)
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/raw").count() == 3
    assert spark.read.parquet(f"{tmp_path}/raw").columns == [*ORDER_EVENT.names, "revenue_cents"]


def test_dedup_with_timers(spark, tmp_path):
    """A repeat within the retention of the accepted row goes, a later one counts anew, in one batch or in several."""
    from ordertide.operators.dedup import keep_first_within

    hour = 3_600_000
    rows = [_event(f"{k}-{s}", s, order_id=k) for k, times in (("a", (0, 60, 3599, 3600, 5000, 7300)), ("b", (10, 3700)), ("c", (7200,))) for s in times]
    events = spark.createDataFrame([tuple(r[c] for c in ORDER_EVENT.names) for r in rows], ORDER_EVENT)
    want = sorted((r.order_id, r.timestamp) for r in keep_first_within(events, "order_id", hour).collect())
    for files in (1, 3):
        kept = replay_dedup(spark, events, f"file://{tmp_path}/{files}", "order_id", hour, files=files)
        assert sorted((r.order_id, r.timestamp) for r in kept.collect()) == want
    assert len(want) == 6


def test_order_id_key_wall_clock_and_counters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("".join(json.dumps(_event(i, i, order_id=f"o{i % 4}")) + "\n" for i in range(12)))
    progress = Progress()
    spark.streams.addListener(progress)
    try:
        drain(write_table(raw_events(spark.readStream.text(f"{tmp_path}/in"), key="order_id", retention_ms=None), f"{tmp_path}/raw", f"{tmp_path}/ck", once=True))
        raw = spark.read.parquet(f"{tmp_path}/raw")
        assert raw.count() == 4
        for _ in range(60):
            if progress.total().duplicates == 8:
                break
            time.sleep(0.25)
        assert progress.total().rows == 12 and progress.total().state_rows == 4 and "8 duplicates" in progress.report()
    finally:
        spark.streams.removeListener(progress)
    before = time.time() * 1000 - 60_000
    q = rollup_stream(spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/raw"), clock="wall").writeStream.outputMode("complete").format("memory").queryName("wall").trigger(availableNow=True).start()
    drain(q)
    assert spark.table("wall").agg(F.min("window_start_1m")).first()[0] >= before and spark.table("wall").agg(F.sum("order_count")).first()[0] == 4


def _lines(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))


def _wait(of, seconds=90):
    end = time.time() + seconds
    while time.time() < end and not of():
        time.sleep(0.3)
    return of()


def test_counters_of_a_retention_run(spark, tmp_path):
    """Known repeats and bad records, in state of our own, over two runs of a query beside another; reports come by themselves."""
    said = []
    progress = Progress(every=0, out=said.append)
    spark.streams.addListener(progress)
    try:
        for n, rows in enumerate(([_event(i % 5, i) for i in range(12)] + ["{bad"], [_event(i, i) for i in range(4, 9)])):
            _lines(tmp_path / "in", f"{n}.json", rows)
            q = write_table(raw_events(spark.readStream.text(f"{tmp_path}/in"), retention_ms=3_600_000), f"{tmp_path}/raw", f"{tmp_path}/ck", every="300 milliseconds")
            assert _wait(lambda: str(q.id) in progress.of and progress.of[str(q.id)].rows == (13, 18)[n])  # noqa: B023
            q.stop()
        other = write_table(raw_events(spark.readStream.text(f"{tmp_path}/in"), key="order_id", retention_ms=None), f"{tmp_path}/raw2", f"{tmp_path}/ck2", once=True)
        drain(other)
        assert _wait(lambda: str(other.id) in progress.of and progress.of[str(other.id)].rows == 18)
        c = progress.of[str(q.id)]
        assert (c.bad, c.unique, c.duplicates, c.state_rows) == (1, 9, 8, 9)
        assert spark.read.parquet(f"{tmp_path}/raw").count() == 9
        assert progress.total().rows == 36 and said and "36 rows in" in said[-1]
    finally:
        spark.streams.removeListener(progress)


@pytest.mark.parametrize("key", ["event_id", "order_id"])
def test_retention_by_processing_time_expires(spark, tmp_path, key):
    _lines(tmp_path / "in", "a.json", [_event("a", 0, order_id="o"), _event("a", 1, order_id="o")])
    q = write_table(raw_events(spark.readStream.text(f"{tmp_path}/in"), key=key, retention_ms=6_000), f"{tmp_path}/raw", f"{tmp_path}/ck", every="500 milliseconds")
    rows = lambda: sum(p.numInputRows for p in q.recentProgress)
    kept = lambda: [r.timestamp - T0 for r in spark.read.parquet(f"{tmp_path}/raw").orderBy("timestamp").collect()]
    try:
        assert _wait(lambda: rows() == 2)
        began = time.time()
        _lines(tmp_path / "in", "b.json", [_event("a", 2, order_id="o")])
        assert _wait(lambda: rows() == 3)
        assert time.time() - began > 6 or kept() in ([0], [1])  # known still, and not refreshed by the repeat
        time.sleep(max(0, began + 7 - time.time()))
        _lines(tmp_path / "in", "c.json", [_event("a", 3, order_id="o"), _event("b", 4, order_id="p")])
        assert _wait(lambda: rows() == 5)
    finally:
        q.stop()
    assert kept()[-2:] == [3000, 4000]


@pytest.mark.parametrize("key", ["event_id", "order_id"])
def test_retention_by_event_time_expires(spark, tmp_path, key):
    hour = 3600
    files = [[("a", 0), ("a", 0)], [("a", 1800), ("b", hour)], [("c", 2.5 * hour)], [("d", 2.6 * hour)], [("a", 2.7 * hour), ("a", 10)]]
    for n, rows in enumerate(files):
        _lines(tmp_path / "in", f"{n}.json", [_event(k, s, order_id=k) for k, s in rows])
        drain(write_table(raw_events(spark.readStream.text(f"{tmp_path}/in"), key=key, retention_ms=hour * 1000, clock="event"), f"{tmp_path}/raw", f"{tmp_path}/ck", once=True))
    got = sorted(((r[key], (r.timestamp - T0) / 1000) for r in spark.read.parquet(f"{tmp_path}/raw").collect()))
    # accepted again once its retention is over; the row at 10 is behind the watermark
    assert got == [("a", 0.0), ("a", 2.7 * hour), ("b", hour), ("c", 2.5 * hour), ("d", 2.6 * hour)]


def test_wall_windows_end_without_input(spark, tmp_path):
    """The last window comes out with no later event; what a stop leaves open is flushed, and is replaced by the whole if the query goes on."""
    store = Store(f"file://{tmp_path}/tables", {"per_restaurant": Kept("latest", ("restaurant_id", "window_start")), "overall": Kept("latest", ("window_start",))})
    size = 4_000

    def start():
        values = spark.readStream.text(f"{tmp_path}/in")
        return rank_walls(combined(parse_json(values, on_bad_record="skip")), store, f"{tmp_path}/ck", size_ms=size, k=2, every="500 milliseconds")

    _lines(tmp_path / "in", "a.json", [_event(i, i, menu_item_id=f"I{i % 3}") for i in range(9)] + [_event(90, 1, menu_item_id="I2")])
    q = start()
    try:
        assert _wait(lambda: store.exists(spark)), q.lastProgress
    finally:
        q.stop()
    top = store.read(spark, "per_restaurant").orderBy("rank").collect()
    assert [(r.menu_item_id, r.order_count) for r in top] == [("I2", 4), ("I0", 3)] and top[0].window_end - top[0].window_start == size
    assert abs(top[0].window_end / 1000 - time.time()) < 120  # by the clock, not by the events
    size = 3_600_000  # of a query of its own: its window stays open
    store = Store(f"file://{tmp_path}/tables2", store.tables)
    values = spark.readStream.text(f"{tmp_path}/in")
    q = rank_walls(combined(parse_json(values, on_bad_record="skip")), store, f"{tmp_path}/ck2", size_ms=size, k=2, every="500 milliseconds")
    assert _wait(lambda: sum(p.numInputRows for p in q.recentProgress) == 10)
    q.stop()
    assert not store.exists(spark)
    assert flush_walls(spark, store, f"{tmp_path}/ck2", k=2) == 3
    assert [(r.menu_item_id, r.order_count) for r in store.read(spark, "overall").orderBy("rank").collect()] == [("I2", 4), ("I0", 3)]
    assert flush_walls(spark, store, f"{tmp_path}/ck2", k=2) == 3 and store.read(spark, "overall").count() == 2


def test_console_report(spark, tmp_path):
    said = []
    spark.createDataFrame([tuple(_event(i, i, menu_item_id=f"I{i % 3}", menu_item_name=f"Item {i % 3}", price_in_cents=100 * (i % 3))[c] for c in ORDER_EVENT.names) for i in range(9)], ORDER_EVENT).write.parquet(f"{tmp_path}/in")
    drain(console_report(spark.readStream.schema(ORDER_EVENT).parquet(f"{tmp_path}/in"), f"{tmp_path}/ck", k=2, width=8, out=said.append, once=True))
    assert said[-1].splitlines()[1:] == ["  1. Item 2            $6.00", "  2. Item 1            $3.00"]


def test_dedup_keeps_keys_in_groups(spark, tmp_path):
    """Many keys: rows are those of the batch operator, and state has a row for each group of keys, not for each key."""
    from ordertide.operators.dedup import keep_first_within
    from ordertide.streaming.stateful import GROUPS

    hour = 3_600_000
    rows = [_event(f"e{i}", i * 7, order_id=f"o{i * i % 3001}") for i in range(6000)]
    events = spark.createDataFrame([tuple(r[c] for c in ORDER_EVENT.names) for r in rows], ORDER_EVENT)
    cols = ["order_id", "event_id", "customer_id", "quantity", "price_in_cents", "timestamp"]
    want = sorted(map(tuple, keep_first_within(events, "order_id", hour).select(*cols).collect()), key=str)
    got = replay_dedup(spark, events, f"file://{tmp_path}/kept", "order_id", hour, files=2).select(*cols).collect()
    assert sorted(map(tuple, got), key=str) == want
    assert len({r.order_id for r in got}) > GROUPS
    assert 0 < spark.read.format("statestore").load(f"file://{tmp_path}/kept/ck").count() <= GROUPS
