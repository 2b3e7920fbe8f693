"""The store's commits, the serving tables that streams add to, and the star-tree."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from ordertide.operators import startree
from ordertide.operators.rollup import CUBE_DIMS, rollup
from ordertide.operators.topk import top_k_global, top_k_per_restaurant
from ordertide.plans import catalog
from ordertide.plans.serving import Serving
from ordertide.plans.store import Kept, Store
from ordertide.schemas import ORDER_EVENT
from ordertide.sources.streams import folder_writer
from ordertide.streaming.jobs import chain, drain, serve_topk

DAY = 86_400_000
T0 = 1704067200000
TABLES = {"a": Kept("append", ("k",), "t"), "b": Kept("latest", ("k",), "t"), "c": Kept("add", ("k",), last=("name",))}


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), "k int, t bigint, v bigint")


def test_a_commit_shows_all_or_nothing(spark, tmp_path):
    store = Store(f"file://{tmp_path}/s", TABLES)
    assert not store.exists(spark)
    with pytest.raises(ValueError, match="nothing is stored"):
        store.read(spark, "a")
    txn = store.begin(spark)
    txn.put("a", _rows(spark, (1, T0, 1), (2, T0 + DAY, 2), (3, None, 3)))
    txn.put("b", _rows(spark, (1, T0, 1), (1, T0, 2), (2, T0, 5)))
    assert txn.read("a").count() == 3 and not store.exists(spark)
    txn.commit("q", 0)
    killed = store.begin(spark)  # between two outputs
    killed.put("a", _rows(spark, (4, T0, 9)))
    assert store.read(spark, "a").count() == 3
    again = store.begin(spark)
    assert again.done("q", 0) and not again.done("q", 1) and not again.done("other", 0)
    again.put("a", _rows(spark, (4, T0, 9)))
    again.put("b", _rows(spark, (1, T0, 7)))
    again.commit("q", 1)
    assert store.read(spark, "a").count() == 4  # what was killed doesn't count twice
    assert sorted((r.k, r.v) for r in store.read(spark, "b").collect()) == [(1, 7), (2, 5)]  # a key's rows are replaced together
    assert [r.k for r in store.read(spark, "a", T0 + DAY, T0 + 2 * DAY).collect()] == [2]
    with pytest.raises(Exception, match="exists"):
        killed.n = again.n
        killed.commit()
    txn = store.begin(spark)
    txn.put("a", _rows(spark, (8, T0, 8)), replace="dates")
    txn.commit()
    assert sorted(r.k for r in store.read(spark, "a").collect()) == [2, 3, 8]
    assert store.expire(spark, "a", T0 + DAY) == ["2024-01-01"] and sorted(r.k for r in store.read(spark, "a").collect()) == [2, 3]


def test_a_reader_keeps_its_commit(spark, tmp_path):
    store = Store(f"file://{tmp_path}/s", TABLES)
    for v in (1, 2):
        txn = store.begin(spark)
        txn.put("b", _rows(spark, (1, T0, v)), replace="dates")
        txn.commit()
        if v == 1:
            held = store.read(spark, "b")
    assert held.first().v == 1 and store.read(spark, "b").first().v == 2
    assert Store(f"file://{tmp_path}/s", TABLES).read(spark, "b").first().v == 2


def test_fold_add_and_vacuum(spark, tmp_path):
    store = Store(f"file://{tmp_path}/s", TABLES, fold=3, history=1)
    for i in range(6):
        txn = store.begin(spark)
        txn.put("c", spark.createDataFrame([(1, i, f"n{i}"), (2 + i, 1, "x")], "k int, v bigint, name string"))
        txn.put("b", _rows(spark, (i % 2, T0, i)))
        assert bool(txn.fold("b")) == (i in (3, 5)) or i == 5
        txn.fold("c")
        txn.commit()
    got = {r.k: (r.v, r.name) for r in store.read(spark, "c").collect()}
    assert got[1] == (15, "n5") and len(got) == 7
    assert sorted((r.k, r.v) for r in store.read(spark, "b").collect()) == [(0, 4), (1, 5)]
    gone = store.vacuum(spark)
    assert gone > 0 and store.vacuum(spark) == 0
    assert sorted((r.k, r.v) for r in Store(f"file://{tmp_path}/s", TABLES).read(spark, "b").collect()) == [(0, 4), (1, 5)]


def _events(spark, n=3000, days=3, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        item = rng.randrange(30)
        rows.append((f"e{i}", f"o{i // 2}", f"c{rng.randrange(400)}", f"R{min(rng.randrange(12), 5)}", f"I{item}", None if item == 7 else f"K{item % 4}", f"n{item}", rng.randrange(1, 5), rng.randrange(100, 900), T0 + rng.randrange(days * DAY)))
    return spark.createDataFrame(rows, ORDER_EVENT)


def _sums(rolled, dims):
    return sorted(map(tuple, rolled.groupBy(*dims).agg(*[F.sum(c).alias(c) for c in startree.SUMS]).collect()), key=str)


def test_stream_grows_the_served_tables(spark, tmp_path):
    """Windows in seven batches, some cut across two; sums of all 32 levels, rankings and customers equal those of the whole."""
    events = _events(spark)
    rolled = rollup(events, "1 hour").cache()
    rolled.repartitionByRange(7, "window_start_1m", "menu_item_id").write.parquet(f"{tmp_path}/in")
    serving = Serving(f"file://{tmp_path}/served", k=3, limit=150, fold=4)
    read = lambda: spark.readStream.schema(rolled.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    drain(serve_topk(read(), serving, f"{tmp_path}/ck", once=True))
    assert serving.store.read(spark, "rollup").count() == rolled.count()
    for n in range(6):
        for dims in itertools.combinations(CUBE_DIMS, n):
            got = serving.sums(spark, list(dims))
            assert sorted(map(tuple, got.collect()), key=str) == _sums(rolled, dims), dims
    for name, want in (("restaurant_topk", top_k_per_restaurant(rolled, 3)), ("global_topk", top_k_global(rolled, 3))):
        assert sorted(map(tuple, serving.store.read(spark, name).collect())) == sorted(map(tuple, want.collect()))
    before = serving.store.mark(spark)["n"]
    drain(serve_topk(read(), serving, f"{tmp_path}/ck2", once=True))  # another query brings the same windows again
    assert serving.store.read(spark, "rollup").count() == rolled.count() and serving.store.mark(spark)["n"] == before
    tree = {r.level: r["count"] for r in serving.store.read(spark, "tree").groupBy("level").count().collect()}
    assert 8 < len(tree) < 32 and serving.store.mark(spark)["notes"]["divided"]
    exact = {(r.restaurant_id, r.day_of_week): r.n for r in events.withColumn("day_of_week", (F.weekday(F.timestamp_millis("timestamp")) + 1).cast("int")).groupBy("restaurant_id", "day_of_week").agg(F.count_distinct("customer_id").alias("n")).collect()}
    got = {(r.restaurant_id, r.day_of_week): r.unique_customers for r in serving.sums(spark, ["restaurant_id", "day_of_week"], customers=True).collect()}
    assert got.keys() == exact.keys() and all(abs(got[k] - n) <= max(1, 0.05 * n) for k, n in exact.items())
    ranged = {r.restaurant_id: r.unique_customers for r in serving.sums(spark, ["restaurant_id"], T0, T0 + DAY - 1, customers=True).collect()}
    want = {r.restaurant_id: r.n for r in events.where(F.col("timestamp") < T0 + DAY).groupBy("restaurant_id").agg(F.count_distinct("customer_id").alias("n")).collect()}
    assert all(abs(ranged[k] - n) <= max(1, 0.05 * n) for k, n in want.items())


def test_topics_get_what_the_tables_get_at_least_once(spark, tmp_path):
    """The second topic fails at first: nothing is committed, the replay sends the first one's rows again, and tables and topics agree."""
    rolled = rollup(_events(spark), "1 hour").drop("unique_customers_hll")
    rolled.coalesce(1).write.parquet(f"{tmp_path}/in")
    serving = Serving(f"file://{tmp_path}/served", k=2)
    fails = [True]

    def second(keyed):
        if fails[0]:
            raise RuntimeError("topic is away")
        folder_writer(f"{tmp_path}/topics/global_topk")(keyed)

    def run():
        topics = {"restaurant_topk": folder_writer(f"{tmp_path}/topics/restaurant_topk"), "global_topk": second, "rollup": folder_writer(f"{tmp_path}/topics/rollup")}
        drain(serve_topk(spark.readStream.schema(rolled.schema).parquet(f"{tmp_path}/in"), serving, f"{tmp_path}/ck", topics=topics, once=True))

    with pytest.raises(Exception, match="topic is away"):
        run()
    assert not serving.store.exists(spark)
    fails[0] = False
    run()
    for name, want, times in (("restaurant_topk", top_k_per_restaurant(rolled, 2), 2), ("global_topk", top_k_global(rolled, 2), 1)):
        sent = spark.read.json(f"{tmp_path}/topics/{name}").collect()
        stored = sorted(map(tuple, want.collect()))
        assert sorted(map(tuple, serving.store.read(spark, name).collect())) == stored and len(sent) == times * len(stored)
        assert {(r.key, *json.loads(r.value).values()) for r in sent} == {(x[want.columns.index("menu_item_id")], *x) for x in stored}
    rows = spark.read.schema("key string, value string").json(f"{tmp_path}/topics/rollup")
    assert rows.count() == rolled.count() and rows.where("key IS NOT NULL").isEmpty()


def test_raw_topic_and_names_of_topics(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("".join(json.dumps({"event_id": str(i % 4), "order_id": "o", "customer_id": "c", "restaurant_id": "R", "menu_item_id": "I", "category_id": "k", "menu_item_name": "n", "quantity": 2, "price_in_cents": 3, "timestamp": T0 + i}) + "\n" for i in range(9)))
    run = lambda at, names: chain(spark, spark.readStream.text(f"{tmp_path}/in"), Serving(f"file://{at}/served"), str(at), retention_ms=None, topics={n: folder_writer(f"{at}/topics/{n}") for n in names}, once=True)
    assert len(run(tmp_path / "a", ["raw", "rollup"])) == 3
    sent = spark.read.json(f"{tmp_path}/a/topics/raw").collect()
    assert sorted((r.key, json.loads(r.value)["revenue_cents"]) for r in sent) == [(str(i), 6) for i in range(4)]
    assert not (tmp_path / "a/topics/rollup").exists()  # its window is still open
    with pytest.raises(ValueError, match="no such served table"):
        run(tmp_path / "b", ["tree"])


def test_tree_divides_large_nodes_alone(spark):
    finest = startree.records(rollup(_events(spark), "1 hour")).cache()
    counts = startree.nodes(finest)
    of = {(r.level, r.restaurant_id, r.category_id, r.menu_item_id, r.hour_of_day): r.records for r in counts.collect()}
    divided = counts.where("records > 150")
    rows = startree.levels(finest, divided, [r[0] for r in divided.select("level").distinct().collect()]).collect()
    for r in rows:
        if r.level == startree.ROOT:
            continue
        up = startree.above(r.level)
        dims = set(startree.dims_of(up))
        assert of[(up, *(r[d] if d in dims else None for d in CUBE_DIMS[:-1]))] > 150
    whole = startree.levels(finest, counts, [r[0] for r in counts.select("level").distinct().collect()]).count()
    assert 0 < len(rows) < whole / 4
    assert len({r.level for r in rows}) > 8


def test_sketches_keep_their_error_bound(spark):
    """Over 300 groups of 600 to 3000 customers, in sketches of 2^12 registers: nearly all within three standard errors."""
    rows = spark.range(300 * 30).select(F.concat(F.lit("R"), F.col("id") % 300).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("j"), "id")
    rows = rows.where("j < 20 + (id % 300) div 4").select("g", F.concat(F.col("id"), F.lit("-"), F.col("j")).alias("c"), (F.col("id") % 7).alias("part"))
    sketches = rows.groupBy("g", "part").agg(F.hll_sketch_agg("c").alias("s"))
    est = sketches.groupBy("g").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("est"))
    got = est.join(rows.groupBy("g").agg(F.count_distinct("c").alias("n")), "g").select((F.abs(F.col("est") - F.col("n")) / F.col("n")).alias("e")).collect()
    error = 1.04 / (1 << 12) ** 0.5
    assert len(got) == 300 and sum(r.e > 3 * error for r in got) <= 3 and sum(r.e > error for r in got) < 150


def test_merge_job_is_one_commit(spark, tmp_path):
    events = _events(spark, 1200, 4)
    minutes = rollup(events, "1 minute").cache()
    serving = Serving(f"file://{tmp_path}/served").write(minutes)
    store, now = serving.store, T0 + 3 * DAY + 5 * 3_600_000
    cut = now - DAY
    want = {tuple(d): _sums(minutes, d) for d in (["restaurant_id"], ["menu_item_name"])}

    def same():
        assert _sums(serving.rolled(spark), ["restaurant_id"]) == want[("restaurant_id",)]
        assert sorted(map(tuple, serving.sums(spark, ["menu_item_name"], T0, T0 + 9 * DAY).collect()), key=str) == want[("menu_item_name",)]
        assert sorted(map(tuple, serving.sums(spark, ["restaurant_id"]).collect()), key=str) == want[("restaurant_id",)]

    with pytest.raises(RuntimeError, match="killed"), pytest.MonkeyPatch.context() as m:
        real = type(store.begin(spark)).put

        def put(self, name, rows, **kw):
            if name == "rollup":  # coarse rows are written, fine ones aren't dropped yet
                raise RuntimeError("killed")
            return real(self, name, rows, **kw)

        m.setattr("ordertide.plans.store.Transaction.put", put)
        serving.merge(spark, now)
    same()
    assert store.read(spark, "rollup").count() == minutes.count()
    assert serving.merge(spark, now) == cut
    same()
    n = store.mark(spark)["n"]
    assert serving.merge(spark, now) == cut and store.mark(spark)["n"] == n  # again: nothing more
    assert store.read(spark, "rollup").agg(F.min("window_start_1m")).first()[0] >= cut
    hours = store.read(spark, "rollup_hours")
    assert hours.where(F.col("window_start_1m") % 3_600_000 != 0).count() == 0 and hours.agg(F.max("window_start_1m")).first()[0] < cut
    assert serving.merge(spark, now + 2 * 3_600_000) == cut + 2 * 3_600_000
    same()
    assert not serving.append(minutes.where(F.col("window_start_1m") < cut), "again", 0)  # merged windows aren't counted twice
    same()
    exact = events.groupBy("restaurant_id").agg(F.count_distinct("customer_id").alias("n"))
    got = {r.restaurant_id: r.unique_customers for r in serving.sums(spark, ["restaurant_id"], T0, T0 + 9 * DAY, customers=True).collect()}
    assert all(abs(got[r.restaurant_id] - r.n) <= 0.05 * r.n for r in exact.collect())
    late = serving.sums(spark, ["restaurant_id"], T0 + 3 * DAY, T0 + 9 * DAY).agg(F.sum("order_count")).first()[0]
    assert serving.expire(spark, T0 + 33 * DAY, 30) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert serving.sums(spark, []).first().order_count == late < 1200


def test_served_customers_are_counted(spark, tmp_path):
    """Groups of many customers, where a sketch's estimate is off: the stored customers give the number, and a later batch without them is noticed."""
    rows = spark.range(30_000).select(
        F.col("id").alias("event_id"), (F.col("id") % 21_001).alias("user_id"), F.when(F.col("id") % 3 > 0, F.lit("view")).alias("event_type"),
        F.lit('{"k": 7}').alias("props"), F.lit(1.5).alias("value"), F.timestamp_millis(F.lit(T0) + F.col("id") * 60_000).alias("ts"),
    )
    rows.write.parquet(f"file://{tmp_path}/events.parquet")
    got = catalog.QUERIES["unique_customers_served"](spark, f"file://{tmp_path}").collect()
    of = lambda keep: len({i % 21_001 for i in range(30_000) if keep(i % 3)})
    assert {(r.restaurant_id, r.unique_customers, r.exact) for r in got} == {("view", of(bool), of(bool)), (None, of(lambda m: not m), of(lambda m: not m))}
    serving = catalog.served(spark, f"file://{tmp_path}")
    serving.append(serving.rolled(spark).limit(1).withColumn("window_start_1m", F.lit(T0 + 400 * DAY)), "again", 1)
    with pytest.raises(ValueError, match="1 dates"):
        serving.sums(spark, ["restaurant_id"], customers="exact")
