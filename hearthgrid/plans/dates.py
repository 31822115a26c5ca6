"""Time filters and usable date ranges (FLT-1, FLT-2, FLT-11..13)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timespan(df: DataFrame, start: str, days: int = 0, hours: int = 0, seconds: int = 0) -> DataFrame:
    """Rows from ``start`` to ``start`` plus the span, both ends included (FLT-1)."""
    lo = F.lit(start).cast("timestamp_ntz")
    hi = lo + F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(0), F.lit(float(seconds)))
    return df.where(F.col("ts").between(lo, hi))


def from_date(df: DataFrame, date: str) -> DataFrame:
    """Rows at or after a date (FLT-2)."""
    return df.where(F.col("ts") >= F.lit(date).cast("timestamp_ntz"))


def before_date(df: DataFrame, date: str) -> DataFrame:
    """Rows up to the end of the day before (FLT-11)."""
    return df.where(F.col("ts") < F.lit(date).cast("timestamp_ntz"))


def date_bounds(readings: DataFrame) -> DataFrame:
    """First and last full date of each household (FLT-12)."""
    return readings.groupBy("household_id").agg(
        F.date_add(F.to_date(F.min("ts")), 1).alias("first_date"),
        F.date_sub(F.to_date(F.max("ts")), 1).alias("last_date"),
    )


def first_complete_midnight(frame: DataFrame, name: str) -> DataFrame:
    """Day of the first midnight row without NULLs."""
    rows = frame.na.drop().where(F.hour("ts") == 0)
    return rows.groupBy("household_id").agg(F.to_date(F.min("ts")).alias(f"{name}_start"))


def min_start(frames: dict[str, DataFrame]) -> DataFrame:
    """Usable start per agent and ``combined``, the latest of them (FLT-13)."""
    parts = [first_complete_midnight(f, name) for name, f in frames.items()]
    out = reduce(lambda a, b: a.join(b, "household_id"), parts)
    return out.withColumn("combined", F.greatest(*[F.col(f"{n}_start") for n in frames]))
