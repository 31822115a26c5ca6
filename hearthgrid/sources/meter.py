"""Meter files and appliance labels (SRC-1, SRC-2, SRC-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthgrid.functions.exprs import null_if_nan
from hearthgrid.session import attach, stage

# Layout of the meter files.
SLOTS = ["Aggregate", *[f"Appliance{i}" for i in range(1, 10)]]
METER_SCHEMA = T.StructType(
    [
        T.StructField("Time", T.TimestampNTZType()),
        T.StructField("Unix", T.LongType()),
        *[T.StructField(s, T.DoubleType()) for s in SLOTS],
        T.StructField("Issues", T.IntegerType()),
    ]
)
HOUSE_FILE = r"House_?(\d+)\.csv"


def read_meter_csv(spark: SparkSession, paths: str | list[str], issues: bool = False) -> DataFrame:
    """Wide meter readings of all houses in one scan; the house number is in the file name."""
    schema = METER_SCHEMA if issues else T.StructType(METER_SCHEMA.fields[:-1])
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(paths)
    )
    house = F.regexp_extract(F.col("_metadata.file_path"), HOUSE_FILE, 1).cast("int")
    return raw.select(
        house.alias("household_id"),
        F.col("Time").alias("ts"),
        *[null_if_nan(F.col(s)).alias(s) for s in SLOTS],
    )


def read_appliance_labels(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Appliance dictionary from readme texts: ``household_id, slot, appliance`` (SRC-2)."""
    texts = spark.read.text(paths, wholetext=True)
    return parse_appliance_labels(texts, "value")


def parse_appliance_labels(texts: DataFrame, column: str) -> DataFrame:
    """Split a readme into its house blocks and number the labels of each.

    A block is ``House n`` followed by ``0.Aggregate, 1.Toaster, ...`` up to the notes.
    """
    house = r"(?s)^\s*(\d+)\s*\n(.*)$"
    blocks = texts.select(
        F.explode(F.filter(F.split(F.col(column), r"(?:^|\n)House (?=\d)"), lambda b, i: i > 0)).alias("b")
    )
    listed = blocks.select(
        F.regexp_extract("b", house, 1).alias("id"),
        F.split(F.regexp_extract("b", house, 2), "!NOTES")[0].alias("items"),
    ).where(F.col("id") != "")
    label = r"(\d)\.\s*([^,\n\t]+)"
    both = F.arrays_zip(
        F.regexp_extract_all("items", F.lit(label), 1).alias("slot"),
        F.regexp_extract_all("items", F.lit(label), 2).alias("appliance"),
    )
    return listed.select(F.col("id").cast("int").alias("household_id"), F.explode(both).alias("p")).select(
        "household_id",
        F.col("p.slot").cast("int").alias("slot"),
        F.trim("p.appliance").alias("appliance"),
    )


def melt(wide: DataFrame, ids: list[str], columns: list[str], name: str = "slot") -> DataFrame:
    """Wide to long (SRC-3); cells without a value are dropped."""
    return wide.unpivot(ids, columns, name, "watts").where(F.col("watts").isNotNull())


def slot_number(slot):
    """``Aggregate`` is slot 0, ``ApplianceN`` slot N."""
    return F.when(slot == "Aggregate", F.lit(0)).otherwise(
        F.regexp_extract(slot, r"(\d+)$", 1).try_cast("int")
    )


def label_slots(long: DataFrame, labels: DataFrame) -> DataFrame:
    """Replace slot names by the appliance labels of the household; a slot without a label keeps its name.

    ``labels`` has ten rows per house.
    """
    numbered = long.withColumnRenamed("slot", "_name").withColumn("slot", slot_number(F.col("_name")))
    return attach(numbered, stage(labels, "labels"), ["household_id", "slot"], "left").select(
        "household_id", F.coalesce("appliance", "_name").alias("appliance"), "ts", "watts"
    )


def read_readings(spark: SparkSession, meter_paths, readme_paths) -> DataFrame:
    """Long labelled readings: SRC-1, SRC-2 and SRC-3 together."""
    long = melt(read_meter_csv(spark, meter_paths), ["household_id", "ts"], SLOTS)
    return label_slots(long, read_appliance_labels(spark, readme_paths))


def to_wide(long: DataFrame, ids: list[str], names: list[str], name: str = "appliance",
            value: str = "watts") -> DataFrame:
    """Long to wide with a given list of columns."""
    return long.groupBy(*ids).pivot(name, names).agg(F.first(value))
