"""Query API over rollups: top-K by rank or revenue, ad-hoc aggregates, and the choice of the table that answers them."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.functions.scalar import dollars, long_or
from ordertide.operators.rollup import CUBE_DIMS
from ordertide.operators.topk import in_range
from ordertide.schemas import TOPK_COLS


def recent_top(topk: DataFrame, start: int, end: int, k: int, restaurant: str | None = None) -> DataFrame:
    """Newest windows first, then rank; ``k`` rows in all."""
    df = topk.where(in_range(start, end) & (F.col("rank") <= k))
    df = df.where(F.col("restaurant_id") == F.lit(restaurant)) if restaurant is not None else df
    return df.select(*TOPK_COLS).orderBy(F.col("window_end").desc(), "rank", "menu_item_id").limit(k)


def top_by_revenue(topk: DataFrame, start: int, end: int, k: int, restaurant: str | None = None) -> DataFrame:
    """The K rows of greatest revenue among ranked rows; ``rank`` stays the rank by count, and an item may repeat across windows."""
    df = topk.where(in_range(start, end))
    df = df.where(F.col("restaurant_id") == F.lit(restaurant)) if restaurant is not None else df
    return df.select(*TOPK_COLS).orderBy(F.col("total_revenue_in_cents").desc(), F.col("window_end").desc(), "rank", "menu_item_id").limit(k)


def top_items(df: DataFrame, since_ms: int, k: int = 10, *, rolled: bool = False) -> DataFrame:
    """Revenue by restaurant and item since an instant, from the raw table or from a rollup."""
    t, rev, n = ("window_start_1m", F.sum("sum_revenue_cents"), F.sum("order_count")) if rolled else ("timestamp", F.sum("revenue_cents"), F.count(F.lit(1)))
    g = df.where(F.col(t) > since_ms).groupBy("restaurant_id", "menu_item_id")
    return g.agg(rev.alias("total_revenue_cents"), n.alias("order_count")).orderBy(F.col("total_revenue_cents").desc(), "restaurant_id", "menu_item_id").limit(k)


def revenue_by_hour(rolled: DataFrame, since_ms: int) -> DataFrame:
    g = rolled.where(F.col("window_start_1m") > since_ms).groupBy("hour_of_day")
    return g.agg(dollars(F.sum("sum_revenue_cents")).alias("revenue"), F.sum("order_count").alias("order_count")).orderBy("hour_of_day")


def route(dims: set[str], *, time_range: bool, has_cube: bool = True) -> str:
    """The smallest table that answers a sum over these dimensions: cube, rollup or raw."""
    if has_cube and not time_range and dims <= set(CUBE_DIMS):
        return "cube"
    return "rollup" if dims <= {*CUBE_DIMS, "window_start_1m", "menu_item_name"} else "raw"


class Engine:
    """Answers requests from the ranked tables, per restaurant and global: DataFrames, or functions that read those of a range."""

    def __init__(self, per_restaurant: DataFrame | Callable[[int, int], DataFrame], overall: DataFrame | Callable[[int, int], DataFrame]):
        of = lambda t: t if callable(t) else lambda start, end: t
        self.per_restaurant, self.overall = of(per_restaurant), of(overall)

    @staticmethod
    def health() -> dict:
        return {"status": "healthy"}

    @staticmethod
    def params(start: object = None, end: object = None, k: object = None, now_ms: int | None = None) -> tuple[int, int, int]:
        """Defaults: the last hour, 10 rows; what doesn't parse takes its default. ``k`` below 1 is an error."""
        now = int(time.time() * 1000) if now_ms is None else now_ms
        n = long_or(k, 10)
        if n < 1:
            raise ValueError("k must be 1 or more")
        return long_or(start, now - 3_600_000), long_or(end, now), n

    def _answer(self, name: str, find, start, end, k, now_ms) -> dict:
        s, e, n = self.params(start, end, k, now_ms)
        everywhere = name.lower() == "all"
        rows = find((self.overall if everywhere else self.per_restaurant)(s, e), s, e, n, None if everywhere else name).collect()  # k rows
        return {"restaurantId": name, "startTime": s, "endTime": e, "k": n, "items": [r.asDict() for r in rows]}

    def top_k(self, restaurant_id: str, start=None, end=None, k=None, *, now_ms: int | None = None) -> dict:
        if not restaurant_id:
            raise ValueError("restaurant id is missing")
        return self._answer(restaurant_id, recent_top, start, end, k, now_ms)

    def top_k_global(self, start=None, end=None, k=None, *, now_ms: int | None = None) -> dict:
        return self._answer("ALL", recent_top, start, end, k, now_ms)

    def top_k_by_revenue(self, restaurant_id: str = "all", start=None, end=None, k=None, *, now_ms: int | None = None) -> dict:
        return self._answer(restaurant_id or "all", top_by_revenue, start, end, k, now_ms)
