"""Rankings in state: what a batch touches, when state goes, and what a killed batch leaves."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ordertide.operators.parse import keyed_json
from ordertide.operators.rollup import rollup
from ordertide.operators.topk import top_k_global, top_k_per_restaurant
from ordertide.plans.store import Kept, Store
from ordertide.schemas import ORDER_EVENT, TOPK_COLS
from ordertide.sources.streams import folder_writer
from ordertide.streaming.jobs import drain, keep
from ordertide.streaming.ranking import combined, ranked_stream

T0 = 1704067200000
TABLES = {"ranked": Kept("latest", ("ranked_for", "period"))}


def _event(i, second, r="R1", item="I1", q=1):
    return (f"e{i:05d}", f"o{i}", "c", r, item, "k", "n" + item, q, 100, T0 + int(second * 1000))


def _run(spark, at, batch, rows, **kw):
    """One more micro-batch of the same query; the query."""
    spark.createDataFrame(rows, ORDER_EVENT).coalesce(1).write.parquet(f"{at}/in/{batch}")
    events = spark.readStream.schema(ORDER_EVENT).parquet(f"{at}/in/*")
    store = Store(f"file://{at}/tables", TABLES)
    q = keep(ranked_stream(combined(events), **{"k": 2, "salts": 3} | kw), store, {"ranked": lambda b: b}, f"{at}/ck", once=True)
    drain(q)
    return q, store


def _tops(store, spark):
    return {(r.ranked_for, (r.window_start - T0) // 1000, r.rank): (r.menu_item_id, r.order_count) for r in store.read(spark, "ranked").collect()}


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    rows = [_event(i, i % 50, item=f"I{i % 40:02d}") for i in range(400)]
    q, store = _run(spark, tmp_path, 0, rows, lateness="1 day")
    assert _tops(store, spark) == {("R1", 0, 1): ("I00", 10), ("R1", 0, 2): ("I01", 10)}
    q, store = _run(spark, tmp_path, 1, [_event(1000, 3, item="I30")], lateness="1 day")
    # of 40 items in state one is written, with its key's and the ranking's places
    last = [p for p in q.recentProgress if p.numInputRows][-1]
    assert sum(s.numRowsTotal for s in last.stateOperators) >= 40
    assert sum(s.numRowsUpdated for s in last.stateOperators) <= 4
    assert _tops(store, spark) == {("R1", 0, 1): ("I30", 11), ("R1", 0, 2): ("I00", 10)}


def test_rankings_equal_a_batch_over_many_micro_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [_event(i, rng.randrange(300), rng.choice(("R1", "R2", "R3")), f"I{min(rng.randrange(20), rng.randrange(20))}", rng.randrange(1, 4)) for i in range(900)]
    for overall in (False, True):
        for n in range(4):
            _, store = _run(spark, tmp_path / str(overall), n, rows[n::4], k=3, overall=overall, lateness="1 hour")
        rolled = rollup(spark.createDataFrame(rows, ORDER_EVENT), sketch=False)
        want = top_k_global(rolled, 3) if overall else top_k_per_restaurant(rolled, 3)
        assert sorted(map(tuple, store.read(spark, "ranked").select(*TOPK_COLS).collect())) == sorted(map(tuple, want.collect()))


def test_state_goes_with_its_window(spark, tmp_path):
    _run(spark, tmp_path, 0, [_event(0, 5), _event(1, 6, item="I2")], lateness="90 seconds")
    _run(spark, tmp_path, 1, [_event(2, 1000)], lateness="90 seconds")
    q, store = _run(spark, tmp_path, 2, [_event(3, 1001), _event(4, 7)], lateness="90 seconds")  # the last is of a window that has gone
    tops = _tops(store, spark)
    assert tops[("R1", 0, 1)] == ("I1", 1) and tops[("R1", 960, 1)] == ("I1", 2)
    last = q.recentProgress[-1]
    assert sum(s.numRowsDroppedByWatermark for p in q.recentProgress for s in p.stateOperators) == 1
    # one item, one list of a key, one list of a ranking and their timers
    assert sum(s.numRowsTotal for s in last.stateOperators) <= 9


def test_best_windows_hold_no_more_than_what_stands(spark, tmp_path):
    day = spark.createDataFrame([_event(i, 3600 * (i % 5), "R1", f"I{i % 17}") for i in range(400)], ORDER_EVENT)
    rolled = rollup(day, "1 hour", sketch=False)
    rolled.repartition(3).write.parquet(f"{tmp_path}/in")
    store = Store(f"file://{tmp_path}/tables", TABLES)
    stream = spark.readStream.schema(rolled.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = keep(ranked_stream(stream, 2, how="max", salts=2), store, {"ranked": lambda b: b}, f"{tmp_path}/ck", once=True)
    drain(q)
    best = {}
    for r in rolled.collect():
        best[r.menu_item_id] = max(best.get(r.menu_item_id, (0, 0)), (r.order_count, -r.window_start_1m))
    want = sorted(best.items(), key=lambda x: (-x[1][0], x[0]))[:2]
    got = [(r.menu_item_id, (r.order_count, -r.window_start)) for r in store.read(spark, "ranked").orderBy("rank").collect()]
    assert got == want
    assert q.recentProgress[-1].stateOperators[-1].numRowsTotal <= 2 * (2 + 1)  # two salts of two items and a list


def test_a_killed_batch_is_replayed_to_the_same_tables(spark, tmp_path):
    """Killed between two outputs: the first isn't seen, and the replay gives what an undisturbed run gives."""
    tables = {"ranked": Kept("latest", ("ranked_for", "period")), "log": Kept("append")}
    spark.createDataFrame([_event(i, i, item=f"I{i % 3}") for i in range(30)], ORDER_EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    store = Store(f"file://{tmp_path}/tables", tables)
    fail = [True]

    def second(b):
        if fail[0]:
            raise RuntimeError("killed")
        return b.select("ranked_for", "rank", "menu_item_id")

    def start():
        events = spark.readStream.schema(ORDER_EVENT).parquet(f"{tmp_path}/in/*")
        ranked = ranked_stream(combined(events), 2, salts=2, lateness="1 day")
        send = (lambda b: keyed_json(b, "menu_item_id"), folder_writer(f"{tmp_path}/topic"))
        return keep(ranked, store, {"ranked": lambda b: b, "log": second}, f"{tmp_path}/ck", sends=[send], once=True)

    with pytest.raises(Exception, match="killed"):
        drain(start())
    assert not store.exists(spark)
    fail[0] = False
    drain(start())
    assert store.read(spark, "ranked").count() == 2 and store.read(spark, "log").count() == 2
    sent = [(r.key, json.loads(r.value)["rank"]) for r in spark.read.json(f"{tmp_path}/topic").collect()]
    assert sorted(set(sent)) == [("I0", 1), ("I1", 2)] and len(sent) == 4  # a topic gets a batch at least once
    assert store.vacuum(spark) == 1
