"""Positions of rows in a total order, without a task that holds all rows or all rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthgrid.session import stage


def ranked(rows: DataFrame, key: str, *order: str, name: str = "ranked") -> DataFrame:
    """``rows`` with ``rank``, the place from 0 in its ``key``, and ``total``, the number of rows of the key.

    ``key`` is not NULL. Rows are sorted in ranges of (key, order), so a hot key lies in many ranges; a range's first place in
    a key follows from one count per range and key. ``rows`` should be a written table, as Spark reads it twice to cut
    the ranges.
    """
    at = F.monotonically_increasing_id()
    laid = stage(
        rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_at", at)
        .withColumn("_range", F.shiftright("_at", 33)),
        name,
    )
    counts = laid.groupBy(key, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # one row per range and key
    of_key = Window.partitionBy(key)
    before = of_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(
        counts.select(
            key, "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
            F.sum("_n").over(of_key).alias("total"),
        ),
        f"{name}-starts",
    )
    out = laid.join(starts, [key, "_range"])
    return out.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("rank"), "total")
