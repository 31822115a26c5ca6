"""Time arithmetic on TIMESTAMP_NTZ that does not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthgrid.config import WEEKDAYS, WEEKDAY_DUMMIES


def day_start(ts: Column) -> Column:
    return F.to_date(ts).cast("timestamp_ntz")


def hour_start(ts: Column) -> Column:
    """Floor to the hour (RES-3)."""
    return day_start(ts) + F.make_dt_interval(F.lit(0), F.hour(ts))


def at_hour(day: Column, hour: Column) -> Column:
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour)


def bin_start(ts: Column, unit: str) -> Column:
    if unit == "hour":
        return hour_start(ts)
    if unit == "day":
        return day_start(ts)
    raise ValueError(f"unknown unit {unit!r}, use 'hour' or 'day'")


def bin_range(lo: Column, hi: Column, unit: str) -> Column:
    """Array of bin starts from ``lo`` to ``hi``, both included (RES-4)."""
    step = {"hour": F.expr("interval 1 hour"), "day": F.expr("interval 1 day")}[unit]
    return F.sequence(lo, hi, step)


def weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def day_name(ts: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(ts) + 1)


def is_weekend(ts: Column) -> Column:
    """FEA-11."""
    return (F.weekday(ts) >= 5).cast("int")


def weekday_dummies(ts: Column) -> list[Column]:
    """0/1 columns per weekday; Friday, first in alphabetical order, is the base (FEA-6)."""
    return [
        (F.weekday(ts) == WEEKDAYS.index(d)).cast("int").alias(f"day_name_{d}")
        for d in WEEKDAY_DUMMIES
    ]
