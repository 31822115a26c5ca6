"""Registry of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgrid.catalog.oracle import statement

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the views of :mod:`hearthgrid.catalog.oracle`."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = statement(sql)
        return fn

    return register


# Means of decimal readings are often exact ties of a rounding; this moves them off the tie.
NUDGE = 3e-8


def rounded(df: DataFrame, digits: int = 6, nudge: float = 0.0, **other: int) -> DataFrame:
    """Round all DOUBLE columns, so that sums in another order compare equal."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(F.col(c) + nudge, other.get(c, digits)) for c in doubles})
