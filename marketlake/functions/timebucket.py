"""Grains: where a bucket starts and ends, in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grains in roll-up order, with the grain that each is made from and the look-back of its refresh.
CHILD = {"15m": "1m", "1h": "15m", "4h": "1h", "1d": "4h", "1w": "1d", "1M": "1d"}
LOOKBACK = {"15m": "2 hours", "1h": "8 hours", "4h": "1 day", "1d": "7 days", "1w": "60 days", "1M": "400 days"}
SECONDS = {"1m": 60, "15m": 900, "1h": 3600, "4h": 14400}
CALENDAR = {"1d": ("day", "1 day"), "1w": ("week", "7 days"), "1M": ("month", "1 month")}


def bucket_start(ts: Column, grain: str) -> Column:
    """Fixed widths count from the epoch; days, Monday weeks and months follow the calendar."""
    if grain in SECONDS:
        return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / SECONDS[grain]) * SECONDS[grain])
    return F.date_trunc(CALENDAR[grain][0], ts)


def bucket_end(start: Column, grain: str) -> Column:
    if grain in SECONDS:
        return start + F.expr(f"interval {SECONDS[grain]} seconds")
    return start + F.expr(f"interval {CALENDAR[grain][1]}")


def window_lower(as_of: Column, grain: str) -> Column:
    """Start of the first whole bucket that a refresh covers."""
    return bucket_start(as_of - F.expr(f"interval {LOOKBACK[grain]}"), grain)
