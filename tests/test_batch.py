import json
import random

import pytest
from pyspark.sql import functions as F

from ordertide.functions.scalar import ago_ms, iso_duration_ms, long_or
from ordertide.operators.dedup import History, keep_first, keep_first_within
from ordertide.operators.parse import good_and_bad, keyed_json, parse_json, to_raw
from ordertide.operators.rollup import cube, merge_first, merge_rollup, rollup
from ordertide.operators.topk import running_revenue, top_k_global, top_k_per_restaurant
from ordertide.plans.engine import Engine, recent_top, revenue_by_hour, route, top_by_revenue
from ordertide.plans.http import respond
from ordertide.plans.serving import Serving, compact
from ordertide.plans.tables import global_topk_spec, raw_spec
from ordertide.schemas import ORDER_EVENT, ROLLUP_KEY
from ordertide.sources.generate import generate

T0 = 1704067200000


@pytest.fixture(scope="module")
def rolled(golden):
    return rollup(keep_first(golden), exact=True).cache()


def test_rollup_golden(rolled):
    got = {(r.window_start_1m - T0, r.restaurant_id, r.menu_item_id): (r.sum_quantity, r.sum_revenue_cents, r.order_count, r.unique_customers) for r in rolled.collect()}
    assert got == {(0, "R1", "I1"): (3, 3897, 2, 2), (0, "R1", "I2"): (1, 1499, 1, 1), (0, "R2", "I1"): (4, 5196, 1, 1), (60000, "R1", "I1"): (1, 1299, 1, 1), (60000, "R2", "I3"): (3, 2697, 1, 1)}
    r = rolled.first()
    assert (r.hour_of_day, r.day_of_week) == (0, 1)


def test_rankings(rolled):
    top = {(r.restaurant_id, r.rank): r.menu_item_id for r in top_k_per_restaurant(rolled).where(F.col("window_start") == T0).collect()}
    assert top == {("R1", 1): "I1", ("R1", 2): "I2", ("R2", 1): "I1"}
    g = [(r.rank, r.menu_item_id, r.order_count, r.total_quantity, r.total_revenue_in_cents) for r in top_k_global(rolled).where(F.col("window_start") == T0).orderBy("rank").collect()]
    assert g == [(1, "I1", 3, 7, 9093), (2, "I2", 1, 1, 1499)]
    e = [(r.rank, r.menu_item_id) for r in top_k_global(rolled, mode="entries").where(F.col("window_start") == T0).orderBy("rank").collect()]
    assert e == [(1, "I1"), (2, "I1"), (3, "I2")]


def test_api(rolled):
    top = top_k_per_restaurant(rolled)
    assert [(r.window_start - T0, r.menu_item_id) for r in recent_top(top, T0, T0 + 120000, 2, "R1").collect()] == [(60000, "I1"), (0, "I1")]
    assert [r.menu_item_id for r in recent_top(top, T0, T0 + 119999, 2, "R1").collect()] == ["I1", "I2"]
    assert [r.total_revenue_in_cents for r in top_by_revenue(top, T0, T0 + 120000, 2, "R1").collect()] == [3897, 1499]
    engine = Engine(top, top_k_global(rolled))
    status, body = respond(engine, f"/api/v1/restaurants/R1/topk?start={T0}&end={T0 + 120000}&k=2")
    assert status == 200 and body["restaurantId"] == "R1" and len(body["items"]) == 2 and json.dumps(body)
    assert respond(engine, f"/api/v1/restaurants/all/topk/revenue?start={T0}&end={T0 + 120000}")[1]["restaurantId"] == "all"
    assert respond(engine, "/health") == (200, {"status": "healthy"})
    assert respond(engine, "/api/v1/restaurants//topk")[0] == 400
    assert respond(engine, "/api/v1/restaurants/R1/topk?k=0")[0] == 500
    assert Engine.params("x", None, "y", 5_000_000) == (1_400_000, 5_000_000, 10)


def test_served_tables(spark, rolled, tmp_path):
    serving = Serving(f"file://{tmp_path}/served")
    assert not serving.exists(spark) and serving.write(rolled).exists(spark)
    engine = serving.engine(spark)
    for k, end in ((2, T0 + 120000), (2, T0 + 119999), (10, T0 + 10**9)):
        top, both = top_k_per_restaurant(rolled), top_k_global(rolled)
        assert [r.asDict() for r in recent_top(top, T0, end, k, "R1").collect()] == engine.top_k("R1", T0, end, k)["items"]
        assert [r.asDict() for r in top_by_revenue(both, T0, end, k).collect()] == engine.top_k_by_revenue("all", T0, end, k)["items"]
    serving.write(rolled)  # again: the same dates are replaced
    assert serving.store.read(spark, "rollup").count() == rolled.count()
    got = {r.restaurant_id: (r.sum_revenue_cents, r.order_count) for r in serving.sums(spark, ["restaurant_id"]).collect()}
    assert got == {"R1": (6695, 4), "R2": (7893, 2)}
    assert serving.sums(spark, []).first().order_count == 6 and serving.sums(spark, ["menu_item_name"], T0, T0 + 1).agg(F.sum("order_count")).first()[0] == 4
    with pytest.raises(ValueError, match="customer_id"):
        serving.sums(spark, ["customer_id"])
    day = 86_400_000
    later = rolled.withColumns({c: F.col(c) + 3 * day for c in ("window_start_1m", "window_start_ts", "window_end")})
    serving.write(later)  # other dates stay
    files = serving.top(spark, T0, T0 + 120000, 2, "R1").inputFiles()
    assert files and all("dt=2024-01-01" in f for f in files)
    assert serving.sums(spark, []).first().order_count == 12 and serving.top(spark, T0 + day, T0 + 2 * day, 2, "R1").count() == 0
    spec = global_topk_spec(f"file://{tmp_path}/by_name")
    spec.write(top_k_global(rolled))
    name = spec.create(spark)
    assert spark.sql(f"SELECT count(*) FROM {name}").first()[0] == top_k_global(rolled).count()
    spark.sql(f"DROP TABLE {name}")


def test_compact_waits_for_the_buffer(spark, golden):
    fine = rollup(keep_first(golden))
    assert compact(fine, T0 + 86_400_000).count() == 0
    hours = compact(fine, T0 + 86_400_000 + 3_600_000)
    assert {(r.restaurant_id, r.menu_item_id): r.order_count for r in hours.collect()} == {("R1", "I1"): 3, ("R1", "I2"): 1, ("R2", "I1"): 1, ("R2", "I3"): 1}
    assert hours.select(F.hll_sketch_estimate("unique_customers_hll").alias("u")).agg(F.max("u")).first()[0] == 2


def test_running_and_hours(golden, rolled):
    got = {r.menu_item_id: r.total_revenue for r in running_revenue(keep_first(golden)).collect()}
    assert got == {"I1": 10392, "I3": 2697, "I2": 1499} and sum(v // 100 for v in got.values()) == 143
    assert [(r.hour_of_day, r.revenue) for r in revenue_by_hour(rolled, T0 - 1).collect()] == [(0, 145.88)]


def test_dedup_order_id_drops_other_lines(golden):
    assert "e2" not in {r.event_id for r in keep_first(golden, "order_id", ["timestamp", "event_id"]).collect()}


def test_dedup_nulls_and_retention(spark):
    rows = [(k, "o", "c", "r", "i", "k", "n", 1, 1, t) for k, t in (("a", 0), ("a", 5), ("a", 10), ("a", 12), (None, 1), (None, 1))]
    df = spark.createDataFrame(rows, ORDER_EVENT)
    assert keep_first(df).count() == 3
    assert sorted(r.timestamp for r in keep_first_within(df, "event_id", 10).collect()) == [0, 10]
    assert keep_first(df.limit(0)).count() == 0


def test_parse_policies(spark):
    good = '{"event_id":"e","order_id":"o","customer_id":"c","restaurant_id":"r","menu_item_id":"i","category_id":"k","menu_item_name":"n","quantity":1,"price_in_cents":2,"timestamp":3,"extra":1}'
    v1 = '{"order_id":"o","restaurant_id":"r","menu_item_id":"i","menu_item_name":"n","quantity":1,"price_in_cents":2,"timestamp":3}'
    df = spark.createDataFrame([(good,), (v1,), ("{bad",), (None,)], "value string")
    ok, bad = good_and_bad(parse_json(df))
    assert ok.count() == 1 and bad.count() == 3
    assert parse_json(df, on_bad_record="skip", accept_v1=True).count() == 2
    with pytest.raises(Exception, match="bad order event"):
        parse_json(df, on_bad_record="fail").collect()


def test_round_trip_and_revenue(golden):
    back = parse_json(keyed_json(golden, "event_id"), on_bad_record="fail")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, golden.collect()))
    assert to_raw(golden).where("event_id = 'e4'").first().revenue_cents == 5196


def test_merge_and_cube(rolled):
    hourly = merge_rollup(rolled.drop("unique_customers"))
    got = {(r.restaurant_id, r.menu_item_id): r.sum_revenue_cents for r in hourly.collect()}
    assert got[("R1", "I1")] == 5196
    total = cube(rolled).where("level = 31").first()
    assert total.sum_revenue_cents == 14588 and total.order_count == 6
    cols = [*ROLLUP_KEY, "menu_item_name", "sum_quantity", "order_count"]
    assert merge_first(rolled.select(*cols), rolled.select(*cols), ROLLUP_KEY).agg(F.sum("order_count")).first()[0] == 6
    assert merge_first(rolled.select(*cols), rolled.select(*cols), ROLLUP_KEY, "increment").agg(F.sum("order_count")).first()[0] == 12


def test_table_retention(spark, golden, tmp_path):
    spec = raw_spec(f"file://{tmp_path}/raw")
    late = golden.limit(1).withColumn("timestamp", F.lit(T0 + 20 * 86_400_000).cast("bigint"))
    for _ in range(2):
        spec.write(to_raw(golden.unionByName(late)))
    assert spec.read(spark).count() == 8
    assert spec.read(spark, T0, T0 + 3000).count() == 2
    assert spec.expire(spark, T0 + 20 * 86_400_000) == ["dt=2024-01-01"]
    assert spec.read(spark).count() == 1


def test_generator_is_seeded(spark):
    a, b = (sorted(map(tuple, generate(spark, 200, partitions=p).collect())) for p in (2, 5))
    assert a == b and len({r[0] for r in a}) == 200


def test_scalars():
    assert iso_duration_ms("PT24H") == 86_400_000 and iso_duration_ms("PT7D") == 7 * 86_400_000 and ago_ms("PT1M", 60_000) == 0
    assert long_or("12", 1) == 12 and long_or("x", 1) == 1 and long_or(str(2**63), 1) == 1 and long_or(None, 3) == 3
    assert route({"restaurant_id"}, time_range=False) == "cube" and route({"customer_id"}, time_range=True) == "raw" and route({"menu_item_id"}, time_range=True) == "rollup"


def test_retention_against_a_loop(spark):
    rng = random.Random(11)
    rows = [(f"k{rng.randrange(9)}", "o", "c", "r", "i", "k", "n", 1, 1, rng.randrange(400)) for _ in range(400)] + [("far", "o", "c", "r", "i", "k", "n", 1, 1, t) for t in (0, 5, 1000, 1009, 1010, 1011, 3000)]
    want, last = [], {}
    for k, t in sorted({(r[0], r[-1]) for r in rows}):
        if k not in last or t >= last[k] + 10:
            last[k] = t
            want.append((k, t))
    got = keep_first_within(spark.createDataFrame(rows, ORDER_EVENT), "event_id", 10)
    assert sorted((r.event_id, r.timestamp) for r in got.collect()) == want and got.columns == ORDER_EVENT.names


def test_history_is_not_moved(spark, golden, tmp_path):
    history = History(spark, "keys_test", f"file://{tmp_path}/keys", buckets=8)
    assert history.new(golden).count() == golden.count()
    history.add(golden.where("event_id <= 'e3'"))
    assert sorted(r.event_id for r in history.new(golden).collect()) == ["e4", "e5", "e6"]
    plan = history.new(golden)._jdf.queryExecution().executedPlan().toString()
    seen = plan[plan.index("_seen"):] if "_seen" in plan else plan
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1 and "Exchange" not in plan[plan.index("Scan parquet"):] and seen
    history.add(history.new(golden))
    assert history.new(golden).count() == 0
    assert spark.table(history.name).count() == 6
    spark.sql(f"DROP TABLE {history.name}")
