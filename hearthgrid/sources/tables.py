"""Prices, weather, configurations and result tables (SRC-4, SRC-6..8, SNK-*)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthgrid.config import WEATHER_COLUMNS
from hearthgrid.functions.exprs import null_if_nan, within
from hearthgrid.session import stage, staged_bytes

# Column names of the price files and of the configuration files.
PRICE_INTERVAL = "MTU (UTC)"
PRICE_SCHEMA = T.StructType(
    [T.StructField(PRICE_INTERVAL, T.StringType()), T.StructField("price", T.DoubleType())]
)
CONFIG_SCHEMA = T.StructType(
    [
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField("household", T.IntegerType()),
                    T.StructField("first_date", T.StringType()),
                    T.StructField("last_date", T.StringType()),
                    T.StructField("start_dates", T.MapType(T.StringType(), T.StringType())),
                ]
            ),
        ),
        T.StructField(
            "user_input",
            T.StructType(
                [
                    T.StructField("shiftable_devices", T.ArrayType(T.StringType())),
                    T.StructField("active_appliances", T.ArrayType(T.StringType())),
                    T.StructField("threshold", T.DoubleType()),
                ]
            ),
        ),
    ]
)


def interval_start(text: Column, fmt: str = "dd.MM.yyyy HH:mm") -> Column:
    """Start of a ``start - end`` interval text, read with an explicit format."""
    return F.to_timestamp_ntz(F.trim(F.split(text, " - ")[0]), F.lit(fmt))


def read_prices_csv(spark: SparkSession, paths, fmt: str = "dd.MM.yyyy HH:mm") -> DataFrame:
    """Day-ahead prices: ``ts, price`` (SRC-4)."""
    raw = spark.read.schema(PRICE_SCHEMA).option("header", True).csv(paths)
    return raw.select(interval_start(F.col(f"`{PRICE_INTERVAL}`"), fmt).alias("ts"), "price")


def read_weather(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A weather table supplied by the user: ``ts`` and the known weather columns (SRC-6)."""
    reader = spark.read
    if fmt == "csv":
        fields = [T.StructField("ts", T.TimestampNTZType())]
        fields += [T.StructField(c, T.DoubleType()) for c in WEATHER_COLUMNS]
        reader = reader.schema(T.StructType(fields)).option("header", True)
    raw = reader.format(fmt).load(path)
    present = [c for c in WEATHER_COLUMNS if c in raw.columns]
    return raw.select(
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        *[null_if_nan(F.col(c).cast("double")).alias(c) for c in present],
    )


def read_configs(spark: SparkSession, paths, lines: bool = False) -> DataFrame:
    """All configuration documents of a folder, one row each (SRC-7): one per file, or one per line."""
    return spark.read.schema(CONFIG_SCHEMA).option("multiLine", not lines).json(paths)


def device_legend(configs: DataFrame, positions: int) -> DataFrame:
    """Household by device position table of the shiftable devices (SRC-8).

    A household with more devices than ``positions`` is an error.
    """
    listed = configs.select(
        F.col("data.household").alias("household"),
        F.posexplode("user_input.shiftable_devices").alias("pos", "device"),
    ).withColumn("pos", within(F.col("pos"), positions))
    wide = listed.groupBy("household").pivot("pos", list(range(positions))).agg(F.max("device"))
    return wide.select("household", *[F.col(f"`{i}`").alias(f"device_{i}") for i in range(positions)])


BUCKET = "_bucket"
#: Bytes of Parquet that a file is laid out for.
FILE_BYTES = 128 << 20


def write_table(
    df: DataFrame, path: str, key: str | None = None, buckets: int = 64, mode: str = "overwrite", file_bytes: int = FILE_BYTES
) -> None:
    """Persist a prepared table, output or result as parquet (SNK-1).

    With ``key``, rows go to one folder per hash bucket of the key: the number of folders does not grow with the number of keys. The table is
    written to the staging area first, which measures it: as many tasks write as it has ``file_bytes``, and a bucket
    above that is split into as many files. Overwriting replaces the buckets that ``df`` has rows in and leaves the others; with an empty ``df``
    it replaces nothing.
    """
    if key is None:
        df.write.mode(mode).parquet(path)
        return
    numbered = stage(df.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "table")
    size = staged_bytes(numbered)
    rows = {r[BUCKET]: r["n"] for r in numbered.groupBy(BUCKET).agg(F.count("*").alias("n")).collect()}
    if not rows:
        return
    share = size / sum(rows.values())
    files = {b: max(1, math.ceil(n * share / file_bytes)) for b, n in rows.items()}
    # rows of a split bucket are dealt by all their values, so that a task that runs again deals them alike
    parts = F.element_at(F.create_map(*[F.lit(v) for p in sorted(files.items()) for v in p]), F.col(BUCKET))
    dealt = numbered.withColumn("_file", F.pmod(F.xxhash64(*numbered.columns), parts))
    tasks = max(math.ceil(size / file_bytes), max(files.values()))
    out = dealt.repartition(tasks, BUCKET, "_file").drop("_file")
    out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def write_unscaled_weather(readings_weather: DataFrame, path: str) -> None:
    """Hourly and daily means of the unscaled weather, for explanations (SNK-2)."""
    from hearthgrid.operators.resample import resample_mean

    cols = [c for c in WEATHER_COLUMNS if c in readings_weather.columns]
    for unit in ("hour", "day"):
        keyed = readings_weather.withColumn("_point", F.lit(0))
        resample_mean(keyed, ["_point"], cols, unit).drop("_point").write.mode("overwrite").parquet(
            f"{path.rstrip('/')}/{unit}"
        )


def write_house_means(readings: DataFrame, path: str) -> None:
    """Hourly and daily means of every appliance's unscaled readings (``household_id, appliance, ts, watts``), for explanations (SNK-2)."""
    from hearthgrid.operators.resample import resample_mean

    for unit in ("hour", "day"):
        means = resample_mean(readings, ["household_id", "appliance"], ["watts"], unit)
        write_table(means, f"{path.rstrip('/')}/{unit}", "household_id")


def read_unscaled(spark: SparkSession, path: str, unit: str) -> DataFrame:
    """Means that :func:`write_unscaled_weather` or :func:`write_house_means` wrote, by ``hour`` or ``day``."""
    if unit not in ("hour", "day"):
        raise ValueError(f"unknown unit {unit!r}, use 'hour' or 'day'")
    return read_table(spark, f"{path.rstrip('/')}/{unit}")


SCORE_COLUMNS = ["model", "params", "metric", "value"]


def score_rows(spark: SparkSession, rows: list[tuple[str, dict, str, float]]) -> DataFrame:
    """Results of a parameter search as ``model, params, metric, value``."""
    schema = "model string, params map<string,string>, metric string, value double"
    data = [(m, {k: str(v) for k, v in p.items()}, s, x) for m, p, s, x in rows]
    return spark.createDataFrame(data, schema)


def append_scores(scores: DataFrame, path: str) -> None:
    """Append ``model, params, metric, value`` rows to a table of scores (SNK-3)."""
    scores.select(*SCORE_COLUMNS).write.mode("append").parquet(path)
