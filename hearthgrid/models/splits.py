"""Train and test splits (SPL-1, SPL-2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def activity_split(
    features: DataFrame, date: str, train_start: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Hours before ``date`` from ``train_start`` on, and the 24 hours of ``date`` (SPL-1)."""
    day = F.lit(date).cast("date")
    at = F.to_date("ts")
    train = features.where(at < day)
    if train_start:
        train = train.where(at >= F.lit(train_start).cast("date"))
    return train, features.where(at == day)


def usage_split(
    features: DataFrame, date: str, train_start: str | None = None, leak_free: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Days up to ``date`` and the day itself (SPL-2).

    The training days end before the test day. ``leak_free=False`` keeps the test day in
    the training data, as in published usage scores.
    """
    day = F.lit(date).cast("date")
    train = features.where(F.col("day") < day if leak_free else F.col("day") <= day)
    if train_start:
        train = train.where(F.col("day") >= F.lit(train_start).cast("date"))
    return train, features.where(F.col("day") == day)


def train_start_days_back(date: str, days: int, floor: str = "2013-11-01") -> Column:
    """Start of the training data ``days`` before ``date``, not before ``floor``."""
    back = F.date_sub(F.lit(date).cast("date"), days)
    return F.greatest(back, F.lit(floor).cast("date"))


def fold_start(day: Column, refit_every: str = "month") -> Column:
    """First day of the refit period a row is scored in; models are fitted on earlier days."""
    if refit_every == "day":
        return day
    return F.to_date(F.date_trunc(refit_every, day.cast("timestamp")))
