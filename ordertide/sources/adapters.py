"""Order events from the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_as_orders(events: DataFrame) -> DataFrame:
    """The ``events`` table: its type is the restaurant, its ``k`` the item; three events make an order."""
    k = F.get_json_object("props", "$.k")
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.concat(F.lit("ord_"), F.floor(F.col("event_id") / 3).cast("string")).alias("order_id"),
        F.col("user_id").cast("string").alias("customer_id"), F.col("event_type").alias("restaurant_id"),
        k.alias("menu_item_id"), F.concat(F.lit("cat_"), (k.cast("int") % 4).cast("string")).alias("category_id"),
        F.concat(F.lit("item_"), k).alias("menu_item_name"),
        (F.lit(1) + F.col("event_id") % 4).cast("int").alias("quantity"),
        F.round(F.col("value") * 100).cast("int").alias("price_in_cents"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
    )


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_orders(table(spark, sf_dir, "events"))


def line_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``lineitem`` table: (order, line) repeats, so it exercises the deduplication."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("event_id"), F.col("l_orderkey").cast("string").alias("order_id"),
        F.lit(None).cast("string").alias("customer_id"), F.col("l_suppkey").cast("string").alias("restaurant_id"),
        F.col("l_partkey").cast("string").alias("menu_item_id"), F.col("l_returnflag").alias("category_id"),
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("menu_item_name"), F.col("l_quantity").cast("int").alias("quantity"),
        F.round(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("int").alias("price_in_cents"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("timestamp"),
    )
