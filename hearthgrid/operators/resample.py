"""Regular time grids (RES-1, RES-2, RES-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthgrid.functions.times import bin_range, bin_start


def densify(
    binned: DataFrame,
    keys: list[str],
    span_keys: list[str],
    unit: str = "hour",
    ts: str = "ts",
    zero: list[str] | None = None,
) -> DataFrame:
    """Emit every bin between the first and last bin of each ``span_keys`` group.

    ``binned`` has one row per key and bin. All members (``keys``) of one span group
    share its span. Missing bins carry NULL, or 0 for the columns named in ``zero``.
    """
    grid = span_grid(binned, keys, span_keys, unit, ts)
    out = grid.join(binned, [*keys, ts], "left")
    return out.fillna(0.0, zero) if zero else out


def span_grid(
    binned: DataFrame,
    keys: list[str],
    span_keys: list[str],
    unit: str,
    ts: str,
    limits: dict[str, Column] | None = None,
) -> DataFrame:
    """All keys and bins of the grid; ``limits`` are further aggregates per key to keep.

    Members of a span group (the appliances of a household) are few, so they fit in a list.
    """
    kept = dict(limits or {})
    members = binned.groupBy(*keys).agg(
        F.min(ts).alias("_lo"), F.max(ts).alias("_hi"), *[v.alias(c) for c, v in kept.items()]
    )
    others = [k for k in keys if k not in span_keys]
    if others:
        members = (
            members.groupBy(*span_keys)
            .agg(
                F.min("_lo").alias("_lo"),
                F.max("_hi").alias("_hi"),
                F.collect_list(F.struct(*others, *kept)).alias("_members"),
            )
            .select(*span_keys, "_lo", "_hi", F.explode("_members").alias("_m"))
            .select(*span_keys, "_lo", "_hi", "_m.*")
        )
    return members.select(
        *keys, *kept, F.explode(bin_range(F.col("_lo"), F.col("_hi"), unit)).alias(ts)
    )


def bin_mean(
    df: DataFrame, keys: list[str], values: list[str], unit: str = "hour", ts: str = "ts"
) -> DataFrame:
    return (
        df.groupBy(*keys, bin_start(F.col(ts), unit).alias(ts))
        .agg(*[F.avg(v).alias(v) for v in values])
    )


def resample_mean(
    df: DataFrame,
    keys: list[str],
    values: list[str],
    unit: str = "hour",
    span_keys: list[str] | None = None,
    fill: str = "null",
    ts: str = "ts",
) -> DataFrame:
    """Mean per bin on a gap-free grid (RES-1); ``fill`` is 'null' or 'zero'."""
    if fill not in ("null", "zero"):
        raise ValueError("fill must be 'null' or 'zero'")
    return densify(
        bin_mean(df, keys, values, unit, ts),
        keys,
        span_keys or keys,
        unit,
        ts,
        values if fill == "zero" else None,
    )


def day_counts(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Rows per calendar day; days without rows count 0 (RES-2)."""
    counted = df.groupBy(*keys, bin_start(F.col(ts), "day").alias("ts")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    return densify(counted, keys, keys, "day").select(
        *keys, F.to_date("ts").alias("day"), F.coalesce("n_rows", F.lit(0)).alias("n_rows")
    )


def date_range(spark, start: Column, periods: int, unit: str = "hour") -> DataFrame:
    """``periods`` bins from ``start`` (RES-4)."""
    step = F.make_dt_interval(
        F.lit(periods - 1 if unit == "day" else 0), F.lit(periods - 1 if unit == "hour" else 0)
    )
    one = spark.range(1).select(start.alias("_start"))
    return one.select(F.explode(bin_range(F.col("_start"), F.col("_start") + step, unit)).alias("ts"))
