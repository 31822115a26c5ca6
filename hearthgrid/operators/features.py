"""Feature building on gap-free grids (FEA-*).

Windows here run per household (and device) over grid rows. A key holds at most one
row per hour or day of its calendar, however many raw readings it had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthgrid.config import MONTHS
from hearthgrid.functions.exprs import above
from hearthgrid.functions.times import day_name, is_weekend, weekday


def activity_flag(
    hourly: DataFrame,
    threshold: float | Column,
    appliances: list[str] | Column | None = None,
    value: str = "scaled",
) -> DataFrame:
    """1 when any listed appliance is above the threshold in that hour (FEA-1).

    ``appliances`` is a list of names or a condition. Hours of a household that owns none
    of the listed appliances stay, with 0.
    """
    flag = above(F.col(value), threshold)
    if appliances is not None:
        listed = (
            appliances if isinstance(appliances, Column) else F.col("appliance").isin(*appliances)
        )
        flag = F.when(listed, flag).otherwise(0)
    return hourly.groupBy("household_id", "ts").agg(F.max(flag).alias("activity"))


def calendar(ts: Column) -> dict[str, Column]:
    """All calendar features of a timestamp (FEA-2, FEA-11)."""
    return {
        "hour": F.hour(ts),
        "day_of_week": weekday(ts),
        "day_name": day_name(ts),
        "month": F.month(ts),
        "month_name": F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(ts)),
        "weekend": is_weekend(ts),
    }


def add_calendar(df: DataFrame, features: list[str], ts: str = "ts") -> DataFrame:
    every = calendar(F.col(ts))
    return df.withColumns({f: every[f] for f in features})


def add_lags(
    df: DataFrame, keys: list[str], columns: list[str], lags: tuple[int, ...], order: str = "ts"
) -> DataFrame:
    """``{column}_lag_{k}`` by grid position (FEA-3)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({f"{c}_lag_{k}": F.lag(c, k).over(w) for c in columns for k in lags})


def add_periods_since(
    df: DataFrame, keys: list[str], columns: list[str], order: str = "ts"
) -> DataFrame:
    """``periods_since_last_{column}`` for each column (FEA-4)."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_rn", F.row_number().over(w))
    added = {}
    for c in columns:
        stops = F.when((F.col(c) != 0) | F.col(c).isNull(), F.col("_rn"))
        distance = F.col("_rn") - F.coalesce(F.max(stops).over(before), F.lit(0))
        added[f"periods_since_last_{c}"] = F.when(F.lag(c).over(w).isNotNull(), distance)
    return out.withColumns(added).drop("_rn")


def active_last_2_days(prefix: str = "activity") -> Column:
    """FEA-5; unknown lags count as not active."""
    was_on = lambda k: F.coalesce(F.col(f"{prefix}_lag_{k}") == 1, F.lit(False))
    return (was_on(1) | was_on(2)).cast("int")


def threshold_profile(
    hourly: DataFrame, thresholds: list[float], appliances: list[str] | None = None
) -> DataFrame:
    """Activity and usage ratios by hour, weekday and month for candidate thresholds (FEA-10).

    Returns ``threshold, dimension, bucket, series, ratio``. One pass: each hourly row is
    repeated per threshold and dimension, and combined on the map side.
    """
    rows = hourly if appliances is None else hourly.where(F.col("appliance").isin(*appliances))
    at = rows.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    flagged = at.select(
        "household_id", "ts", "threshold", "appliance",
        above(F.col("scaled"), F.col("threshold")).alias("flag"),
    )
    any_on = flagged.groupBy("household_id", "ts", "threshold").agg(F.max("flag").alias("flag"))
    series = flagged.select(
        "household_id", "ts", "threshold", "flag",
        F.concat(F.col("appliance"), F.lit("_usage")).alias("series"),
    ).unionByName(any_on.withColumn("series", F.lit("activity")))
    ts = F.col("ts")
    buckets = F.array(
        F.struct(F.lit("hour").alias("dimension"), F.hour(ts).alias("bucket")),
        F.struct(F.lit("weekday").alias("dimension"), F.weekday(ts).alias("bucket")),
        F.struct(F.lit("month").alias("dimension"), F.month(ts).alias("bucket")),
    )
    return (
        series.withColumn("_b", F.explode(buckets))
        .groupBy("threshold", F.col("_b.dimension").alias("dimension"),
                 F.col("_b.bucket").alias("bucket"), "series")
        .agg(F.avg("flag").alias("ratio"))
    )


def group_mean(df: DataFrame, by: list[Column], columns: list[str]) -> DataFrame:
    """AGG-1."""
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])


def uses_per_day(load: DataFrame) -> DataFrame:
    """Hours in use per device and day, for days with any use (AGG-6)."""
    return (
        load.where(F.col("load") > 0)
        .groupBy("household_id", "device", F.to_date("ts").alias("day"))
        .agg(F.count(F.lit(1)).alias("uses"))
    )


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every column pair, in one aggregate: ``a, b, corr`` (AGG-7)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    one = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("corr"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return one.select(F.explode(rows).alias("p")).select("p.*")
