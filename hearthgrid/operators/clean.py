"""Cleaning, scaling and profiling of readings (CLN-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthgrid.config import IQR_FACTOR
from hearthgrid.functions.exprs import minmax, winsorise
from hearthgrid.operators.prefix import weighted_quantiles
from hearthgrid.session import attach, stage


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows per key and distinct value; combines on the map side, so hot keys shrink first."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def outlier_bounds(
    df: DataFrame,
    keys: list[str],
    value: str = "watts",
    factor: float = IQR_FACTOR,
) -> DataFrame:
    """Quartiles over the non-zero values and the bounds ``q1 - f*iqr``, ``q3 + f*iqr``."""
    counts = value_counts(df.where(F.col(value) != 0), keys, value)
    quartiles = weighted_quantiles(counts, keys, value, "n", {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return quartiles.select(
        *keys,
        "q1",
        "q3",
        (F.col("q1") - F.lit(factor) * iqr).alias("lower"),
        (F.col("q3") + F.lit(factor) * iqr).alias("upper"),
    )


def with_bounds(
    df: DataFrame,
    keys: list[str],
    value: str = "watts",
    factor: float = IQR_FACTOR,
) -> DataFrame:
    bounds = stage(outlier_bounds(df, keys, value, factor), "bounds")
    return attach(df, bounds.select(*keys, "lower", "upper"), keys, "left")


def truncate_outliers(
    df: DataFrame, keys: list[str], value: str = "watts", factor: float = IQR_FACTOR
) -> DataFrame:
    """IQR winsorising per key over the non-zero rows (CLN-1)."""
    return (
        with_bounds(df, keys, value, factor)
        .withColumn(value, winsorise(F.col(value), F.col("lower"), F.col("upper")))
        .drop("lower", "upper")
    )


def outlier_counts(
    df: DataFrame, keys: list[str], value: str = "watts", factor: float = IQR_FACTOR
) -> DataFrame:
    """How many values CLN-1 replaces, per key (CLN-2)."""
    v = F.col(value)
    out = (v != 0) & ((v > F.col("upper")) | (v < F.col("lower")))
    return (
        with_bounds(df, keys, value, factor)
        .groupBy(*keys)
        .agg(F.count_if(out).alias("n_outliers"), F.count(value).alias("n_values"))
    )


def scale_minmax(df: DataFrame, keys: list[str], value: str = "watts") -> DataFrame:
    """Min-max scaling per key as a new column ``scaled`` (CLN-3)."""
    limits = stage(
        df.groupBy(*keys).agg(F.min(value).alias("_min"), F.max(value).alias("_max")), "limits"
    )
    return (
        attach(df, limits, keys, "left")
        .withColumn("scaled", minmax(F.col(value), F.col("_min"), F.col("_max")))
        .drop("_min", "_max")
    )


def backfill(df: DataFrame, keys: list[str], columns: list[str], order: str = "ts") -> DataFrame:
    """Next known value; trailing NULLs stay (CLN-5). For grid frames: one key is one calendar."""
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.first(c, ignorenulls=True).over(ahead) for c in columns})


def forward_fill(
    df: DataFrame,
    keys: list[str],
    value: str = "watts",
    ts: str = "ts",
    max_gap_seconds: int = 120,
    max_value: float | None = 4000.0,
) -> DataFrame:
    """Raw-reading repair (CLN-6): last known value, or 0 after a gap above ``max_gap_seconds``.

    Readings above ``max_value`` are dropped first. Raw readings of one key are unbounded,
    so the window runs inside a key and day. A day that starts with unknown values
    takes over the last known reading of the days before it, found on a table with one
    row per key and day.
    """
    kept = df if max_value is None else df.where(
        F.col(value).isNull() | (F.col(value) <= max_value)
    )
    kept = kept.withColumn("_day", F.to_date(ts))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(ts).alias("at"), F.col(value).alias("v")))
    days = kept.groupBy(*keys, "_day").agg(F.max(known).alias("_last_of_day"))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(
        *keys, "_day", F.last("_last_of_day", ignorenulls=True).over(before).alias("_carried")
    )
    inside = Window.partitionBy(*keys, "_day").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    filled = kept.withColumn("_inside", F.last(known, ignorenulls=True).over(inside)).join(
        carried, [*keys, "_day"], "left"
    )
    last = F.coalesce("_inside", "_carried")
    too_long = F.make_dt_interval(secs=F.lit(float(max_gap_seconds)))
    return filled.select(
        *[c for c in df.columns if c != value],
        F.when(last.isNull(), F.lit(None).cast("double"))
        .when(F.col(ts) - last["at"] > too_long, F.lit(0.0))
        .otherwise(last["v"])
        .alias(value),
    )


def profile(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Descriptive statistics per key (CLN-7): counts, moments, extremes, exact quartiles."""
    moments = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(value).isNull()).alias("n_null"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    quartiles = weighted_quantiles(
        value_counts(df, keys, value),
        keys,
        value,
        "n",
        {"p25": 0.25, "p50": 0.5, "p75": 0.75},
    ).drop("n")
    return moments.join(quartiles, keys, "left")


def histogram(df: DataFrame, keys: list[str], value: str, bins: int = 50) -> DataFrame:
    """Counts in equal-width bins between the minimum and maximum of each key (CLN-8)."""
    limits = stage(
        df.groupBy(*keys).agg(F.min(value).alias("_min"), F.max(value).alias("_max")), "limits"
    )
    v, lo, hi = F.col(value), F.col("_min"), F.col("_max")
    bin_no = F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(0)
    return (
        attach(df.where(v.isNotNull()), limits, keys)
        .groupBy(*keys, bin_no.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def all_null_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Names of columns without any value, found in one aggregate (FLT-9)."""
    seen = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if seen[c] == 0]


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    return df.drop(*all_null_columns(df, df.columns))
