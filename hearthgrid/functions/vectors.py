"""Arithmetic on day vectors: 24 loads or probabilities, 48 prices per row.

A recommendation needs 24 x 24 products of one profile with one price series. Held as
arrays they stay inside one row, so no row explosion and no shuffle is needed. The
arguments are column names or SQL text: an expression over 24 hours is then one call to
the JVM instead of hundreds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthgrid.config import PROFILE_HOURS


def vector(n: int, item) -> str:
    """SQL array of ``item(0) .. item(n - 1)``."""
    return f"array({', '.join(item(i) for i in range(n))})"


def hour_vector(hour: str, value: str, n: int = PROFILE_HOURS) -> Column:
    """Aggregate: array of values by hour; hours without a row are NULL."""
    return F.expr(vector(n, lambda h: f"max(CASE WHEN {hour} = {h} THEN {value} END)"))


def run_cost(prices: str, hour: str, load: str) -> Column:
    """Cost of a 24 h load started at ``hour``: sum of ``prices[hour+i] * load[i]`` (CST-2)."""
    return F.expr(
        " + ".join(f"get({prices}, {hour} + {i}) * get({load}, {i})" for i in range(PROFILE_HOURS))
    )


def start_costs(prices: str, load: str) -> Column:
    """Cost of the load for each start hour 0..23 (CST-1)."""
    return F.expr(
        f"transform(sequence(0, {PROFILE_HOURS - 1}), s -> aggregate("
        f"zip_with(slice({prices}, s + 1, {PROFILE_HOURS}), {load}, (p, l) -> p * l),"
        " 0D, (total, x) -> total + x))"
    )


def cheapest_hour(costs: str, probabilities: str, threshold: str) -> Column:
    """First cheapest start among the hours that reach the threshold (REC-1, TOP-1).

    Returns ``struct<cost, hour>``, NULL when no hour does.
    """
    return F.expr(
        f"array_min(transform({costs}, (c, h) -> CASE WHEN get({probabilities}, h) >= {threshold}"
        " THEN named_struct('cost', c, 'hour', h) END))"
    )


def nearest_start(starts: str, hour: str) -> Column:
    """Run nearest to ``hour``; ties and an unknown hour give the earliest run (JN-6).

    ``starts`` is an array of ``struct<hour, load>`` for one day.
    """
    return F.expr(
        f"array_min(transform({starts}, s -> named_struct("
        f"'distance', coalesce(abs(s.hour - {hour}), 0), 'hour', s.hour, 'load', s.load)))"
    )
