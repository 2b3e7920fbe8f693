"""Record types of the pipeline, as Spark schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names and types of the wire format.
_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType()}
ORDER_EVENT_DDL = (
    "event_id string, order_id string, customer_id string, restaurant_id string, "
    "menu_item_id string, category_id string, menu_item_name string, "
    "quantity int, price_in_cents int, timestamp bigint"
)
ROLLUP_KEY = ["restaurant_id", "menu_item_id", "window_start_1m"]
TOPK_COLS = [
    "restaurant_id", "menu_item_id", "menu_item_name", "rank", "order_count",
    "total_quantity", "total_revenue_in_cents", "window_start", "window_end",
]

ORDER_EVENT = T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in ORDER_EVENT_DDL.split(", "))])
#: Fields without which a record is no order event; the v1 form has no event_id, customer_id or category_id.
REQUIRED_V2 = [f.name for f in ORDER_EVENT.fields]
REQUIRED_V1 = [c for c in REQUIRED_V2 if c not in ("event_id", "customer_id", "category_id")]
