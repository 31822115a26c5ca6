"""Views that map the test tables onto meter readings, prices, weather and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgrid.config import EngineConfig

# Fixed values of the mapping: 30 users form a household, prices and weather fill 768 hours.
USERS_PER_HOUSEHOLD = 30
SLOTS = 768
FIRST_HOUR = "timestamp_ntz'2024-01-01 00:00:00'"
CONFIG = EngineConfig(
    shiftable_devices=("Washing Machine", "Tumble Dryer", "Dishwasher"),
    active_appliances=("Washing Machine", "Tumble Dryer", "Dishwasher", "Kettle", "Television"),
    activity_threshold=0.5,
    device_threshold=0.8,
    load_threshold=0.05,
    fill="zero",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    appliance = (
        F.when(F.col("event_type") == "click", "Washing Machine")
        .when(F.col("event_type") == "view", "Tumble Dryer")
        .when(F.col("event_type") == "purchase", "Dishwasher")
        .when(F.col("event_type") == "signup", "Kettle")
        .otherwise("Television")
    )
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("user_id") / USERS_PER_HOUSEHOLD).cast("int").alias("household_id"),
        appliance.alias("appliance"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        (F.col("value") * 10).alias("watts"),
    )


def slot_time():
    return F.expr(FIRST_HOUR) + F.make_dt_interval(F.lit(0), F.col("slot").cast("int"))


def _mean(c: str, unit: int = 1, scale: int = 1):
    """Mean of a column with ``unit`` steps per 1, divided by ``scale``.

    The sum runs over whole numbers, so it does not depend on the order of the rows.
    """
    total = F.sum(F.round(F.col(c) * unit).cast("bigint"))
    return total.cast("double") / (F.count(F.lit(1)) * scale).cast("double")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .groupBy((F.col("o_orderkey") % SLOTS).alias("slot"))
        .agg(_mean("o_totalprice", 100, 100_000).alias("price"))
        .select(slot_time().alias("ts"), "price")
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.col("slot")
    with_holes = lambda cond, c: F.when(~cond, c)
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_orderkey") % SLOTS).alias("slot"))
        .agg(
            _mean("l_quantity").alias("temp"),
            _mean("l_discount", 100).alias("dwpt"),
            _mean("l_tax", 1000).alias("rhum"),
            _mean("l_extendedprice", 100, 10_000).alias("wdir"),
            _mean("l_linenumber").alias("wspd"),
        )
        .select(
            slot_time().alias("ts"),
            with_holes(slot % 11 == 3, F.col("temp")).alias("temp"),
            with_holes(slot % 7 == 2, F.col("dwpt")).alias("dwpt"),
            with_holes(slot % 13 == 5, F.col("rhum")).alias("rhum"),
            "wdir",
            "wspd",
        )
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "labels")
        .join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
        .select(
            "doc_id",
            F.col("quality").alias("label"),
            F.round((F.col("n_chars") % 100) / 100.0, 2).alias("score"),
        )
    )
