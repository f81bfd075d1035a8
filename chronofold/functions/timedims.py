"""Computed time dimensions on wall clocks: ``date`` and ``day_of_week``.

Buckets are wall-clock values of the chosen zone without a zone of their own, so the two passes
of a repeated hour share a bucket.  Nothing depends on the session's time zone.
"""

from __future__ import annotations

from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE, DAY_OF_WEEK = "date", "day_of_week"
GRANULARITIES = ("minute", "hour", "day", "week", "month")
DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def zone(name: str | None) -> str:
    """A zone's name; unknown ones fall back to UTC."""
    try:
        return ZoneInfo(name).key if name else "UTC"
    except (KeyError, ValueError, OSError):
        return "UTC"


def wall_clock(seconds: Column, tz: str | None) -> Column:
    """Unix seconds as a wall-clock time of the zone."""
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    name = zone(tz)
    return utc if name == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(name), utc)


def bucket(seconds: Column, granularity: str | None, tz: str | None) -> Column:
    """The start of the minute, hour, day, week (from Monday) or month; anything else counts as day."""
    local = wall_clock(seconds, tz)
    day = local.cast("date")
    if granularity == "week":
        day = F.date_sub(day, F.weekday(day))
    elif granularity == "month":
        day = F.trunc(day, "month")
    start = day.cast("timestamp_ntz")
    none = F.lit(0)
    if granularity == "hour":
        return start + F.make_dt_interval(none, F.hour(local))
    if granularity == "minute":
        return start + F.make_dt_interval(none, F.hour(local), F.minute(local))
    return start


def day_of_week(seconds: Column, tz: str | None) -> Column:
    return F.element_at(F.array(*map(F.lit, DAYS)), F.weekday(wall_clock(seconds, tz).cast("date")) + 1)
