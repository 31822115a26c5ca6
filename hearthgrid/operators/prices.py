"""Day-ahead prices (PRC-*, WIN-1, SRC-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgrid.config import PRICE_HOURS, PROFILE_HOURS
from hearthgrid.functions.times import at_hour
from hearthgrid.functions.vectors import hour_vector


def price_vectors(prices: DataFrame) -> DataFrame:
    """``day, prices``: 48 hourly prices from each day on; days with a gap are left out (PRC-1).

    Each price row serves its own day and the day before, so the table is built by one
    aggregate. It has one row per calendar day, however many households use it.
    """
    hour, day = F.hour("ts"), F.to_date("ts")
    served = prices.select(
        "price",
        F.explode(
            F.array(
                F.struct(day.alias("day"), hour.alias("slot")),
                F.struct(F.date_sub(day, 1).alias("day"), (hour + 24).alias("slot")),
            )
        ).alias("_s"),
    )
    return (
        served.groupBy(F.col("_s.day").alias("day"))
        .agg(
            F.count("price").alias("_n"),
            hour_vector("_s.slot", "price", PRICE_HOURS).alias("prices"),
        )
        .where(F.col("_n") == PRICE_HOURS)
        .drop("_n")
    )


def day_ahead(prices: DataFrame) -> DataFrame:
    """Long form of PRC-1: ``day, slot 0..47, ts, price``."""
    return price_vectors(prices).select(
        "day", F.posexplode("prices").alias("slot", "price")
    ).select("day", "slot", at_hour(F.col("day"), F.col("slot")).alias("ts"), "price")


def price_matrix(prices: DataFrame) -> DataFrame:
    """24 start hours per day, each with the 24 prices from that hour on (WIN-1, PRC-2)."""
    v = price_vectors(prices).withColumn(
        "hour", F.explode(F.sequence(F.lit(0), F.lit(PROFILE_HOURS - 1)))
    )
    return v.selectExpr(
        "day", "hour", *[f"get(prices, hour + {i}) AS price_at_h_{i}" for i in range(PROFILE_HOURS)]
    )


def replicate_years(prices: DataFrame, source_year: int, target_years: list[int]) -> DataFrame:
    """Copy the rows of one year to other years and keep the source rows (SRC-5, SET-1).

    29 February has no counterpart in other years and is not copied.
    """
    rows = prices.where(F.year("ts") == source_year)
    years = F.array(*[F.lit(y) for y in [*target_years, source_year]])
    day = F.to_date("ts")
    moved = F.try_make_timestamp_ntz(
        F.col("_year"), F.month(day), F.day(day), F.hour("ts"), F.minute("ts"), F.lit(0)
    ) + F.make_dt_interval(secs=F.second("ts"))
    return (
        rows.withColumn("_year", F.explode(years))
        .withColumn("ts", moved)
        .where(F.col("ts").isNotNull())
        .drop("_year")
    )


def hourly_mean_price(prices: DataFrame) -> DataFrame:
    return prices.groupBy(F.hour("ts").alias("hour")).agg(F.avg("price").alias("price"))

