"""Device runs and typical load profiles (WIN-2, WIN-3, WIN-5, LOD-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthgrid.config import PROFILE_HOURS
from hearthgrid.functions.exprs import above
from hearthgrid.functions.times import day_start

DEVICE = ["household_id", "device"]
HOURS = [f"h{i + 1}" for i in range(PROFILE_HOURS)]


def device_load(
    hourly: DataFrame, devices: list[str] | None, threshold: float | Column, fill: str = "null"
) -> DataFrame:
    """Mean watts of the hours in which the device is used, else 0 (FEA-9)."""
    rows = hourly if devices is None else hourly.where(F.col("appliance").isin(*devices))
    load = F.col("watts") * above(F.col("scaled"), threshold)
    return rows.select(
        "household_id",
        F.col("appliance").alias("device"),
        "ts",
        (F.coalesce(load, F.lit(0.0)) if fill == "zero" else load).alias("load"),
    )


def drop_partial_first_day(load: DataFrame) -> DataFrame:
    """Drop the first day of a household when it has fewer than 24 hourly rows (FLT-10).

    Grid rows start at the first hour of the household, so its first day is whole
    exactly when the grid starts at midnight.
    """
    first = load.groupBy("household_id").agg(F.min("ts").alias("_first"))
    whole_from = F.when(
        F.col("_first") == day_start(F.col("_first")), F.col("_first")
    ).otherwise(day_start(F.col("_first")) + F.expr("interval 1 day"))
    return (
        load.join(first.select("household_id", whole_from.alias("_from")), "household_id")
        .where(F.col("ts") >= F.col("_from"))
        .drop("_from")
    )


def starts(load: DataFrame, value: str = "load") -> DataFrame:
    """Hours in which a device is switched on: 0 before, positive now (WIN-2, EVL-2).

    The first row counts when it is positive.
    """
    w = Window.partitionBy(*DEVICE).orderBy("ts")
    before = F.lag(value, 1, 0.0).over(w)
    return (
        load.withColumn("_before", before)
        .where((F.col("_before") == 0) & (F.col(value) > 0))
        .drop("_before")
    )


def runs(load: DataFrame, truncate_first_run: bool = True) -> DataFrame:
    """One row per run start with its 24 h load vector (WIN-3, LOD-2).

    The vector is cut at the first hour that is not positive or unknown. With
    ``truncate_first_run`` a run already on in the first row keeps only its first hour.
    """
    w = Window.partitionBy(*DEVICE).orderBy("ts")
    ahead = load.select(
        *DEVICE,
        F.col("ts").alias("start_ts"),
        "load",
        F.lag("load", 1, 0.0).over(w).alias("_before"),
        F.row_number().over(w).alias("_row"),
        F.collect_list(F.expr("coalesce(load, 0D)"))
        .over(w.rowsBetween(0, PROFILE_HOURS - 1))
        .alias("_next"),
    ).where("_before = 0 AND load > 0")
    length = "coalesce(nullif(array_position(transform(_next, x -> x > 0), false), 0) - 1, size(_next))"
    if truncate_first_run:
        length = f"CASE WHEN _row = 1 THEN 1 ELSE {length} END"
    hour = f"transform(sequence(0, {PROFILE_HOURS - 1}), i -> IF(i < run_hours, get(_next, i), 0D))"
    return ahead.selectExpr(
        *DEVICE, "start_ts", f"CAST({length} AS INT) AS run_hours", "_next"
    ).selectExpr(*DEVICE, "start_ts", "run_hours", f"{hour} AS load")


def run_elements(run_table: DataFrame) -> DataFrame:
    """Long form: one row per hour of a run with its offset."""
    return run_table.select(
        *DEVICE, "start_ts", F.posexplode(F.slice("load", F.lit(1), F.col("run_hours"))).alias(
            "offset", "load"
        )
    )


def load_profiles(load: DataFrame, truncate_first_run: bool = True) -> DataFrame:
    """Typical load profile of every device for every day from the data before that day (LOD-1).

    All days at once: a run adds 1 to the start count of its day, and each of its hours adds
    to the sums of the day the hour falls on, so a run across midnight counts only with
    the hours before the target day. Running sums over the days of a device give every
    profile in one pass (WIN-5). Returns ``n_runs`` and ``h1..h24``.
    """
    whole = drop_partial_first_day(load)
    run_table = runs(whole, truncate_first_run)
    hour, day = F.hour("start_ts"), F.to_date("start_ts")
    pieces = F.array(
        F.struct(day.alias("day"), F.lit(1).alias("n"), F.lit(0).alias("shift")),
        F.struct(F.date_add(day, 1).alias("day"), F.lit(0).alias("n"), F.lit(1).alias("shift")),
    )
    # offset i of a run started at hour H falls on the next day when H + i >= 24
    split = run_table.select(
        *DEVICE, "load", "run_hours", hour.alias("_hour"), F.explode(pieces).alias("_p")
    ).where((F.col("_p.shift") == 0) | (F.col("_hour") + F.col("run_hours") > PROFILE_HOURS))
    per_day = split.groupBy(*DEVICE, F.col("_p.day").alias("day")).agg(
        F.sum("_p.n").alias("n"),
        *[
            F.expr(
                f"sum(IF(CAST(_hour + {i} >= {PROFILE_HOURS} AS INT) = _p.shift, load[{i}], 0D))"
            ).alias(h)
            for i, h in enumerate(HOURS)
        ],
    )
    days = whole.select(*DEVICE, F.to_date("ts").alias("day")).distinct()
    dense = days.join(per_day, [*DEVICE, "day"], "left")
    earlier = Window.partitionBy(*DEVICE).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    n = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    totals = dense.select(
        *DEVICE, "day", n.alias("n_runs"), *[F.sum(h).over(earlier).alias(h) for h in HOURS]
    )
    mean = "coalesce(CASE WHEN n_runs > 0 THEN {h} / n_runs END, 0D) AS {h}"
    return totals.selectExpr(*DEVICE, "day", "n_runs", *[mean.format(h=h) for h in HOURS])


def profile_vector() -> Column:
    return F.array(*HOURS)
