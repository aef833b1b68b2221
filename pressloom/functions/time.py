"""Dates and ages. `now` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stamp(text: Column) -> Column:
    """ISO date or timestamp, `/` read as `-`; else the leading year-month-day; else null. No zone means UTC."""
    t = F.regexp_replace(F.trim(text), "/", "-")
    return F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(F.regexp_extract(t, r"^(\d{4}-\d{1,2}-\d{1,2})", 1), F.lit("yyyy-M-d")))


def published(publish_date: Column, fetched_at: Column, now: Column) -> Column:
    """Publication time: a bare date of the fetch day gives the fetch time; else publication, fetch, now."""
    t = stamp(publish_date)
    bare = F.length(F.trim(publish_date)) <= 10
    return F.when(bare & (F.to_date(t) == F.to_date(fetched_at)), fetched_at).otherwise(F.coalesce(t, fetched_at, now))


def tick(ts: Column) -> Column:
    """Start of the 15 minutes that hold `ts`."""
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / 900) * 900)


def age_days(ts: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(ts)) / 86_400_000_000.0


def freshness(age: Column, half_life: float = 4.0, floor: float = 0.35) -> Column:
    """`floor` plus a share that halves every `half_life` days; 1 where there is no half life."""
    if half_life <= 0:
        return F.lit(1.0)
    return floor + (1 - floor) * F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / half_life)


def live(age: Column, hours: int = 336) -> Column:
    """1 just now to 0 at the edge of `hours`, by the logarithm of hours."""
    span = F.log2(F.lit(1 + hours / 6.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.log2(1 + F.greatest(age, F.lit(0.0)) * 24 / 6.0) / span))
