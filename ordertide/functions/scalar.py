"""Calendar, money, duration and parameter helpers."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_time(ms: Column) -> Column:
    """Epoch milliseconds to a timestamp."""
    return F.timestamp_millis(ms)


def hour_of_day(ts: Column) -> Column:
    """In the session's time zone."""
    return F.hour(ts)


def iso_day_of_week(ts: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return (F.weekday(ts) + 1).cast("int")


def revenue_cents(quantity: str = "quantity", price: str = "price_in_cents") -> Column:
    """Widened before the product, so that it can't overflow an int."""
    return F.col(quantity).cast("bigint") * F.col(price).cast("bigint")


def dollars(cents: Column) -> Column:
    return cents / F.lit(100.0)


def dollar_text(cents: Column) -> Column:
    return F.format_string("$%.2f", dollars(cents))


def padded(c: Column, width: int, left: bool = False) -> Column:
    """Pads and never cuts, unlike lpad and rpad alone."""
    pad = F.lpad if left else F.rpad
    return F.when(F.char_length(c) >= width, c).otherwise(pad(c, width, " "))


def window_floor(ms: Column, size_ms: int) -> Column:
    """Start of the epoch-aligned window that holds the instant."""
    return ms - F.pmod(ms, F.lit(size_ms))


_ISO = re.compile(r"P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)D)?(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", re.I)


def iso_duration_ms(text: str) -> int:
    """Milliseconds of an ISO-8601 duration; days are also accepted after the T."""
    m = _ISO.fullmatch(text.strip())
    if not m or not any(m.groups()):
        raise ValueError(f"not a duration: {text!r}")
    w, d, d2, h, mi, s = (float(x or 0) for x in m.groups())
    return round(timedelta(weeks=w, days=d + d2, hours=h, minutes=mi, seconds=s).total_seconds() * 1000)


def ago_ms(duration: str, now_ms: int) -> int:
    return now_ms - iso_duration_ms(duration)


def long_or(value: object, default: int) -> int:
    """An integer parameter, or the default if it is missing or no 64-bit integer."""
    try:
        x = int(str(value).strip()) if re.fullmatch(r"[+-]?\d+", str(value).strip(), re.ASCII) else None
    except ValueError:
        x = None
    return x if x is not None and -(2**63) <= x < 2**63 else default
