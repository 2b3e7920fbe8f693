"""Tumbling-window rollups; the same function serves batch and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.functions.scalar import event_time, hour_of_day, iso_day_of_week, revenue_cents


def with_event_time(events: DataFrame) -> DataFrame:
    return events.withColumn("event_time", event_time(F.col("timestamp")))


def _latest(c: str) -> Column:
    """The value of the last event by (timestamp, event_id), whatever the arrival order."""
    return F.max_by(c, F.struct("timestamp", "event_id"))


def rollup(events: DataFrame, size: str = "1 minute", *, sketch: bool = True, exact: bool = False) -> DataFrame:
    """Sums, counts and unique customers for each (window, restaurant, item).

    ``order_count`` counts event rows. ``sketch`` adds a mergeable HLL of the customers, ``exact`` their number (on a stream
    that holds a set for each group; a batch deals customers out). Events without a timestamp belong to no window. Input with ``event_time`` already set, as streams
    with a watermark have it, is used as it is.
    """
    df = events if "event_time" in events.columns else with_event_time(events)
    aggs = [
        _latest("menu_item_name").alias("menu_item_name"),
        _latest("category_id").alias("category_id"),
        F.coalesce(F.sum(F.col("quantity").cast("bigint")), F.lit(0).cast("bigint")).alias("sum_quantity"),
        F.coalesce(F.sum(revenue_cents()), F.lit(0).cast("bigint")).alias("sum_revenue_cents"),
        F.count(F.lit(1)).alias("order_count"),
    ]
    if sketch:
        aggs.append(F.hll_sketch_agg("customer_id").alias("unique_customers_hll"))
    if exact:
        aggs.append((F.size(F.collect_set("customer_id")).cast("bigint") if df.isStreaming else F.count_distinct("customer_id")).alias("unique_customers"))
    agg = df.groupBy(F.window("event_time", size).alias("w"), "restaurant_id", "menu_item_id").agg(*aggs)
    start = F.col("w.start")
    return agg.select(
        "restaurant_id", "menu_item_id", "menu_item_name", "category_id",
        F.unix_millis(start).alias("window_start_1m"), F.unix_millis(start).alias("window_start_ts"),
        F.unix_millis(F.col("w.end")).alias("window_end"),
        hour_of_day(start).alias("hour_of_day"), iso_day_of_week(start).alias("day_of_week"),
        "sum_quantity", "sum_revenue_cents", "order_count",
        *(["unique_customers_hll"] if sketch else []), *(["unique_customers"] if exact else []),
    )


def merge_rollup(rolled: DataFrame, bucket: str = "hour") -> DataFrame:
    """Compaction of finer windows into buckets: sums add, sketches unite."""
    at = F.date_trunc(bucket, event_time(F.col("window_start_1m")))
    agg = rolled.groupBy(at.alias("bucket"), "restaurant_id", "menu_item_id").agg(
        F.max_by("menu_item_name", "window_start_1m").alias("menu_item_name"),
        F.max_by("category_id", "window_start_1m").alias("category_id"),
        F.sum("sum_quantity").alias("sum_quantity"), F.sum("sum_revenue_cents").alias("sum_revenue_cents"),
        F.sum("order_count").alias("order_count"),
        *([F.hll_union_agg("unique_customers_hll").alias("unique_customers_hll")] if "unique_customers_hll" in rolled.columns else []),
    )
    return agg.select(
        "restaurant_id", "menu_item_id", "menu_item_name", "category_id", F.unix_millis("bucket").alias("window_start_1m"),
        hour_of_day(F.col("bucket")).alias("hour_of_day"), iso_day_of_week(F.col("bucket")).alias("day_of_week"),
        *[c for c in agg.columns if c.startswith(("sum_", "order_count", "unique_"))],
    )


# The order of the dimensions.
CUBE_DIMS = ["restaurant_id", "category_id", "menu_item_id", "hour_of_day", "day_of_week"]


def cube(rolled: DataFrame, dims: list[str] | None = None, *, prefixes_only: bool = False) -> DataFrame:
    """Pre-aggregates over all subsets of the dimensions, or over their prefixes; ``level`` is Spark's grouping id."""
    dims = dims or CUBE_DIMS
    grouped = rolled.rollup(*dims) if prefixes_only else rolled.cube(*dims)
    return grouped.agg(
        F.grouping_id().cast("bigint").alias("level"), F.sum("sum_revenue_cents").alias("sum_revenue_cents"),
        F.sum("sum_quantity").alias("sum_quantity"), F.sum("order_count").alias("order_count"),
    )


def merge_first(existing: DataFrame, new: DataFrame, key: list[str], mode: str = "first") -> DataFrame:
    """Primary-key merge of rollup rows. ``first``: what is stored stays; ``increment``: metrics add up."""
    cols = existing.columns
    both = existing.withColumn("_at", F.lit(0)).unionByName(new.withColumn("_at", F.lit(1)))
    rest = [c for c in cols if c not in key]
    if mode == "increment":
        adds = {"sum_quantity", "sum_revenue_cents", "order_count"}
        return both.groupBy(*key).agg(*[(F.sum(c) if c in adds else F.hll_union_agg(c) if c.endswith("_hll") else F.min_by(c, "_at")).alias(c) for c in rest]).select(*cols)
    return both.groupBy(*key).agg(F.min_by(F.struct(*rest), "_at").alias("_r")).select(*key, "_r.*").select(*cols)
