"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_if_nan(c: Column) -> Column:
    """Every operator works on NULL only; NaN is turned into NULL on ingest."""
    return F.when(~F.isnan(c), c)


def above(c: Column, threshold: Column | float) -> Column:
    """Strict threshold flag; NULL counts as not above (FLT-7)."""
    return F.coalesce(c > threshold, F.lit(False)).cast("int")


def winsorise(v: Column, lower: Column, upper: Column) -> Column:
    """Replace outliers by their bound cut to an integer; zeros and NULLs stay (CLN-1)."""
    cut = lambda b: b.cast("bigint").cast("double")
    return (
        F.when((v != 0) & (v > upper), cut(upper))
        .when((v != 0) & (v < lower), cut(lower))
        .otherwise(v)
    )


def minmax(v: Column, lo: Column, hi: Column) -> Column:
    """Scale to [0, 1]; a constant column becomes 0, NULL stays NULL (CLN-3)."""
    return F.when(hi > lo, (v - lo) / (hi - lo)).when(v.isNotNull(), F.lit(0.0))


def agent_key(device: Column) -> Column:
    """Device label to key: blanks to underscores, brackets removed, lower case (REC-5)."""
    return F.lower(F.translate(device, " ()", "_"))


def saving_percent(price: Column, mean_price: Column) -> Column:
    """Share saved against the mean price of the day, in percent (CST-3)."""
    return F.round((1 - price / mean_price) * 100, 2)


def within(position: Column, positions: int) -> Column:
    """``position`` if it is below ``positions``, else an error when the row is read."""
    message = F.concat(F.lit(f"only {positions} positions, found position "), position.cast("string"))
    return F.when(position < positions, position).otherwise(F.raise_error(message).cast("int"))
