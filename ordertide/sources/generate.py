"""Seeded synthetic order events, as a batch or a throttled stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sizes and ranges of the synthetic menu.
RESTAURANTS = 5
ITEMS = 15
CATEGORIES = 4
LEAST_PRICE, MOST_PRICE = 599, 1899
QUANTITIES = 4
LEAST_CUSTOMER, MOST_CUSTOMER = 1000, 9998


def _pick(n: int, salt: str, seed: int) -> Column:
    """A number in [0, n) that depends on the row's id, the salt and the seed alone."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(salt), F.lit(seed)), F.lit(n))


def _events(ids: DataFrame, at: Column, seed: int) -> DataFrame:
    item = _pick(ITEMS, "item", seed) + 1
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("id")))
    return ids.select(
        F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]).alias("event_id"),
        F.concat(F.lit("ORD"), F.upper(F.substring(digest, 1, 8))).alias("order_id"),
        (_pick(MOST_CUSTOMER - LEAST_CUSTOMER + 1, "customer", seed) + LEAST_CUSTOMER).cast("string").alias("customer_id"),
        F.format_string("REST%03d", _pick(RESTAURANTS, "restaurant", seed) + 1).alias("restaurant_id"),
        F.format_string("ITEM%03d", item).alias("menu_item_id"),
        F.format_string("CAT%03d", F.floor((item - 1) * CATEGORIES / ITEMS) + 1).alias("category_id"),
        F.format_string("Item %d", item).alias("menu_item_name"),
        (_pick(QUANTITIES, "quantity", seed) + 1).cast("int").alias("quantity"),
        (F.lit(LEAST_PRICE) + (item - 1) * F.lit((MOST_PRICE - LEAST_PRICE) // (ITEMS - 1))).cast("int").alias("price_in_cents"),
        at.cast("bigint").alias("timestamp"),
    )


def generate(spark: SparkSession, count: int, *, start_ms: int = 1_704_067_200_000, gap_ms: int = 100, seed: int = 7, partitions: int | None = None) -> DataFrame:
    """``count`` events ``gap_ms`` apart. The same seed gives the same rows, however many partitions."""
    ids = spark.range(0, count, 1, partitions) if partitions else spark.range(count)
    return _events(ids, F.lit(start_ms) + F.col("id") * F.lit(gap_ms), seed)


def generate_stream(spark: SparkSession, rows_per_second: int = 100, *, seed: int = 7) -> DataFrame:
    """Events at a fixed rate, stamped with the source's clock."""
    r = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return _events(r.select(F.col("value").alias("id"), "timestamp"), F.unix_millis("timestamp"), seed)
