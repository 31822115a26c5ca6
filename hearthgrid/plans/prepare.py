"""Preparation pipelines (PIPE-1, PIPE-2, PIPE-3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthgrid.config import WEATHER_COLUMNS, EngineConfig
from hearthgrid.functions.exprs import above, minmax, null_if_nan, winsorise
from hearthgrid.functions.times import hour_start, weekday_dummies
from hearthgrid.operators.clean import backfill, with_bounds
from hearthgrid.operators.features import (
    active_last_2_days,
    activity_flag,
    add_lags,
    add_periods_since,
)
from hearthgrid.operators.resample import span_grid
from hearthgrid.operators.runs import device_load
from hearthgrid.session import attach, stage

METER = ["household_id", "appliance"]


def hourly_readings(readings: DataFrame, factor: float = 1.5, fill: str = "null") -> DataFrame:
    """Winsorised hourly mean watts and their scaled value on a gap-free grid.

    Raw readings are read twice: once reduced to value counts for the quantiles, once
    joined with the bounds and combined to hours before anything is shuffled. Min-max
    scaling is affine, so the scaled mean follows from the mean and the extremes of the
    hours. Returns ``household_id, appliance, ts, watts, scaled``; ``fill='zero'`` sets both
    to 0 in hours without a reading.
    """
    clean = readings.withColumn("watts", null_if_nan(F.col("watts")))
    bounded = with_bounds(clean, METER, "watts", factor)
    cut = bounded.select(
        *METER,
        hour_start(F.col("ts")).alias("ts"),
        winsorise(F.col("watts"), F.col("lower"), F.col("upper")).alias("watts"),
    )
    hours = cut.groupBy(*METER, "ts").agg(
        F.avg("watts").alias("watts"),
        F.min("watts").alias("_min"),
        F.max("watts").alias("_max"),
    )
    limits = {"_lowest": F.min("_min"), "_highest": F.max("_max")}
    grid = span_grid(hours, METER, ["household_id"], "hour", "ts", limits)
    dense = grid.join(hours.select(*METER, "ts", "watts"), [*METER, "ts"], "left")
    scaled = minmax(F.col("watts"), F.col("_lowest"), F.col("_highest"))
    out = dense.select(*METER, "ts", "watts", scaled.alias("scaled"))
    return out.fillna(0.0, ["watts", "scaled"]) if fill == "zero" else out


def join_weather(df: DataFrame, weather: DataFrame, on: str = "ts") -> DataFrame:
    """Left join of a frame with weather on its time column (JN-1).

    Weather has one row per hour or day of the calendar. It is staged, so its size is
    known before it is broadcast.
    """
    return attach(df, stage(weather, "weather"), [on], "left")


def weather_rows_kept(df: DataFrame, weather: DataFrame, on: str = "ts") -> DataFrame:
    """Right join that keeps every weather row, with or without a feature row (JN-2)."""
    return df.join(weather, on, "right")


def daily_weather(weather: DataFrame, agg: str = "mean") -> DataFrame:
    """Weather per day: the mean, or the value at midnight exactly (FEA-8)."""
    cols = [c for c in WEATHER_COLUMNS if c in weather.columns]
    if agg == "mean":
        return weather.groupBy(F.to_date("ts").alias("day")).agg(
            *[F.avg(c).alias(c) for c in cols]
        )
    if agg == "midnight":
        at_midnight = F.col("ts") == F.to_date("ts").cast("timestamp_ntz")
        return weather.where(at_midnight).select(F.to_date("ts").alias("day"), *cols)
    raise ValueError("agg must be 'mean' or 'midnight'")


def activity_features(
    hourly: DataFrame, config: EngineConfig, weather: DataFrame | None = None,
    threshold: float | Column | None = None,
) -> DataFrame:
    """Hourly feature frame per household (PIPE-1)."""
    flags = activity_flag(
        hourly,
        config.activity_threshold if threshold is None else threshold,
        list(config.active_appliances),
    )
    out = flags.withColumn("hour", F.hour("ts"))
    out = add_lags(out, ["household_id"], ["activity"], config.activity_lags)
    out = out.select("*", *weekday_dummies(F.col("ts")))
    if weather is not None:
        cols = [c for c in WEATHER_COLUMNS if c in weather.columns]
        out = join_weather(out, weather.select("ts", *cols))
        out = backfill(out, ["household_id"], cols)
    return out


def daily_flags(
    hourly: DataFrame, shiftable: Column, active: Column, device_threshold: Column,
    activity_threshold: Column,
) -> DataFrame:
    """Long daily flags: ``household_id, day, device, usage, activity`` (FLT-7, RES-1, FEA-7).

    A daily mean of 0/1 flags is positive exactly when one of them is 1, so the daily
    flag is a maximum.
    """
    per_day = hourly.groupBy("household_id", F.to_date("ts").alias("day"), "appliance").agg(
        F.max(above(F.col("scaled"), device_threshold)).alias("usage"),
        F.max(F.when(active, above(F.col("scaled"), activity_threshold)).otherwise(0)).alias("_active"),
        F.max(shiftable).alias("_shiftable"),
    )
    household_day = Window.partitionBy("household_id", "day")
    return (
        per_day.withColumn("activity", F.max("_active").over(household_day))
        .where("_shiftable")
        .select("household_id", "day", F.col("appliance").alias("device"), "usage", "activity")
    )


def daily_usage(hourly: DataFrame, config: EngineConfig) -> DataFrame:
    """Daily flags with the same settings for all households."""
    return daily_flags(
        hourly,
        F.col("appliance").isin(*config.shiftable_devices),
        F.col("appliance").isin(*config.active_appliances),
        F.lit(config.device_threshold),
        F.lit(config.activity_threshold),
    )


def with_household_settings(hourly: DataFrame, configs: DataFrame) -> DataFrame:
    """Add ``threshold``, ``active`` and ``shiftable`` from each household's configuration.

    ``configs`` is the table of configuration documents (SRC-7), one row per household.
    Households without one are left out. All households run in one job (EVL-11).
    """
    settings = configs.select(
        F.col("data.household").alias("household_id"),
        F.col("user_input.threshold").alias("threshold"),
        F.col("user_input.active_appliances").alias("_active"),
        F.col("user_input.shiftable_devices").alias("_shiftable"),
    )
    joined = attach(hourly, stage(settings, "settings"), ["household_id"])
    return joined.select(
        *hourly.columns,
        "threshold",
        F.array_contains("_active", F.col("appliance")).alias("active"),
        F.array_contains("_shiftable", F.col("appliance")).alias("shiftable"),
    )


def household_activity(settled: DataFrame) -> DataFrame:
    """Hourly activity with each household's own appliances and threshold."""
    return activity_flag(settled, F.col("threshold"), F.col("active"))


def household_usage(settled: DataFrame) -> DataFrame:
    """Daily flags with each household's own devices and threshold."""
    return daily_flags(
        settled, F.col("shiftable"), F.col("active"), F.col("threshold"), F.col("threshold")
    )


def household_load(settled: DataFrame, fill: str = "null") -> DataFrame:
    """Hourly loads of each household's own devices (PIPE-2)."""
    return device_load(settled.where("shiftable"), None, F.col("threshold"), fill)


def usage_features(
    hourly: DataFrame, config: EngineConfig, weather: DataFrame | None = None,
    weather_agg: str = "mean",
) -> DataFrame:
    """Daily feature frame per household and device (PIPE-3)."""
    keys = ["household_id", "device"]
    out = daily_usage(hourly, config)
    out = add_periods_since(out, keys, ["activity", "usage"], "day")
    out = add_lags(out, keys, ["activity", "usage"], config.usage_lags, "day")
    out = out.withColumn("active_last_2_days", active_last_2_days()).withColumn(
        "hour", F.lit(0)
    )
    out = out.select("*", *weekday_dummies(F.col("day")))
    if weather is not None:
        cols = [c for c in WEATHER_COLUMNS if c in weather.columns]
        out = join_weather(out, daily_weather(weather, weather_agg), "day")
        out = backfill(out, keys, cols, "day")
    return out


def load_frame(hourly: DataFrame, config: EngineConfig) -> DataFrame:
    """Hourly device loads (PIPE-2)."""
    threshold = (
        config.device_threshold if config.load_threshold is None else config.load_threshold
    )
    return device_load(hourly, list(config.shiftable_devices), threshold, config.fill)
