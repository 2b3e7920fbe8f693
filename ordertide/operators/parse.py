"""JSON values to typed order events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordertide.functions.scalar import revenue_cents
from ordertide.schemas import ORDER_EVENT, REQUIRED_V1, REQUIRED_V2

_BAD = "_bad"


def _complete(required: list[str], at: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{at}.{c}").isNotNull() for c in required))


def parse_json(values: DataFrame, *, column: str = "value", on_bad_record: str = "quarantine", accept_v1: bool = False) -> DataFrame:
    """Order events from JSON text.

    Unknown fields are ignored. A record is bad if it doesn't parse, or lacks a required field. ``on_bad_record``:
    ``fail`` raises when the row is computed, ``skip`` drops it, ``quarantine`` keeps it as a row with the text in
    ``bad_record`` and nulls elsewhere.
    """
    if on_bad_record not in ("fail", "skip", "quarantine"):
        raise ValueError(on_bad_record)
    schema = T.StructType([*ORDER_EVENT.fields, T.StructField(_BAD, T.StringType())])
    text = F.col(column).cast("string")
    parsed = values.select(text.alias("_text"), F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}).alias("_r"))
    good = F.coalesce(F.col(f"_r.{_BAD}").isNull() & _complete(REQUIRED_V1 if accept_v1 else REQUIRED_V2, "_r"), F.lit(False))
    out = [F.when(good, F.col(f"_r.{f.name}")).alias(f.name) for f in ORDER_EVENT.fields]
    if on_bad_record == "quarantine":
        return parsed.select(*out, F.when(~good, F.coalesce("_text", F.lit(""))).alias("bad_record"))
    if on_bad_record == "skip":
        return parsed.where(good).select(F.col("_r.*")).drop(_BAD)
    checked = F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("bad order event: "), F.coalesce("_text", F.lit("null")))).cast("boolean"))
    return parsed.where(checked).select(F.col("_r.*")).drop(_BAD)


def good_and_bad(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both outputs of a quarantining parse."""
    return parsed.where("bad_record IS NULL").drop("bad_record"), parsed.where("bad_record IS NOT NULL").select("bad_record")


def to_raw(events: DataFrame) -> DataFrame:
    """Adds the derived revenue, default 0."""
    return events.withColumn("revenue_cents", F.coalesce(revenue_cents(), F.lit(0).cast("bigint")))


def valid_time(events: DataFrame, *, least: int = 0, most: int = 4102444800000) -> DataFrame:
    """Only rows whose timestamp is a plausible instant."""
    return events.where(F.col("timestamp").between(least, most))


def keyed_json(df: DataFrame, key: str | None) -> DataFrame:
    """Sink form: the key's UTF-8 bytes, and the row as JSON."""
    k = F.col(key).cast("binary") if key else F.lit(None).cast("binary")
    return df.select(k.alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))
