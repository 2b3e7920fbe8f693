"""Top-K rankings over rollups. Ranks are positions 1..n; ties go by item and then restaurant id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordertide.schemas import TOPK_COLS

ALL = "ALL"


def _metrics(rolled: DataFrame) -> DataFrame:
    return rolled.select(
        "restaurant_id", "menu_item_id", "menu_item_name", "order_count",
        F.col("sum_quantity").alias("total_quantity"), F.col("sum_revenue_cents").alias("total_revenue_in_cents"),
        F.col("window_start_1m").alias("window_start"), "window_end",
    )


def _ranked(df: DataFrame, by: list[str], measure: str, k: int) -> DataFrame:
    """``rank <= k`` right on the row number lets Spark cut each group before the shuffle."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    w = Window.partitionBy(*by).orderBy(F.col(measure).desc(), F.col("menu_item_id").asc(), F.col("restaurant_id").asc())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k_per_restaurant(rolled: DataFrame, k: int = 10, measure: str = "order_count") -> DataFrame:
    return _ranked(_metrics(rolled), ["window_start", "restaurant_id"], measure, k).select(*TOPK_COLS)


def top_k_global(rolled: DataFrame, k: int = 10, mode: str = "combined", measure: str = "order_count") -> DataFrame:
    """``combined`` adds the restaurants' rows of an item up first; ``entries`` ranks (restaurant, item) rows, so an item can repeat."""
    m = _metrics(rolled)
    if mode == "combined":
        m = m.groupBy("window_start", "window_end", "menu_item_id").agg(
            F.max_by("menu_item_name", "restaurant_id").alias("menu_item_name"),
            *[F.sum(c).alias(c) for c in ("order_count", "total_quantity", "total_revenue_in_cents")],
        ).withColumn("restaurant_id", F.lit(ALL))
    elif mode != "entries":
        raise ValueError(mode)
    return _ranked(m, ["window_start"], measure, k).withColumn("restaurant_id", F.lit(ALL)).select(*TOPK_COLS)


def best_window_top_k(rolled: DataFrame, k: int = 10, *, is_global: bool = False) -> DataFrame:
    """Ranks each item by its best single window: the metric of greatest order_count, the earliest of equals."""
    m = _metrics(rolled)
    key = ["menu_item_id"] if is_global else ["restaurant_id", "menu_item_id"]
    rest = [c for c in m.columns if c not in key]
    best = m.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("order_count", (-F.col("window_start")).alias("t"), *([F.col("restaurant_id")] if is_global else []))).alias("_r")).select(*key, "_r.*")
    if is_global:
        w = Window.partitionBy(F.lit(0)).orderBy(F.col("order_count").desc(), F.col("menu_item_id").asc())
        top = best.orderBy(F.col("order_count").desc(), F.col("menu_item_id").asc()).limit(k)
        return top.withColumn("rank", F.row_number().over(w)).withColumn("restaurant_id", F.lit(ALL)).select(*TOPK_COLS)
    return _ranked(best, ["restaurant_id"], "order_count", k).select(*TOPK_COLS)


def running_top(events: DataFrame, k: int = 10) -> DataFrame:
    """All-time revenue by item; K rows through TakeOrderedAndProject, never a full sort."""
    return running_revenue(events).orderBy(F.col("total_revenue").desc(), F.col("menu_item_id").asc()).limit(k)


def running_revenue(events: DataFrame) -> DataFrame:
    return events.groupBy("menu_item_id").agg(
        F.max_by("menu_item_name", F.struct("timestamp", "event_id")).alias("menu_item_name"),
        F.sum(F.col("quantity").cast("bigint") * F.col("price_in_cents")).alias("total_revenue"),
    )


def in_range(start: int, end: int) -> Column:
    """The whole window lies in [start, end]."""
    return (F.col("window_start") >= F.lit(start)) & (F.col("window_end") <= F.lit(end))
