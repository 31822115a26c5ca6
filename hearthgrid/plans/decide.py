"""Recommendations and their evaluation (CST-*, REC-*, EVL-1..8, JN-4..8).

Everything about one device and day sits in one row: the profile and the probabilities
as 24-vectors, the prices as a 48-vector, the runs of the day as a short array. Costs,
the cheapest hour, the nearest run and the savings are then row expressions. The only
shuffles are the joins on (household, device, day) that build the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthgrid.config import GRID_THRESHOLDS
from hearthgrid.functions.exprs import saving_percent
from hearthgrid.functions.times import at_hour
from hearthgrid.functions.vectors import (
    cheapest_hour,
    hour_vector,
    nearest_start,
    run_cost,
    start_costs,
)
from hearthgrid.operators.prices import price_vectors
from hearthgrid.operators.runs import DEVICE, profile_vector
from hearthgrid.session import attach, stage

# Wording of the recommendation messages.
MESSAGE_DEVICE = "You have a recommendation for the following device: "
MESSAGE_DAY = "\n\nPlease use the device on the "
MESSAGE_HOUR = " at "
MESSAGE_REASON = " o'clock because it saves you "
MESSAGE_SHARE = " % of costs compared to the mean of the day.\n"
MESSAGE_NONE = "There is no recommendation for the device "
MESSAGE_DATE_FORMAT, MESSAGE_HOUR_FORMAT = "dd.MM.yyyy", "HH:mm"

KEY = [*DEVICE, "day"]
SUMMARY = [
    "n_recommendations", "acceptable", "total_savings",
    "relative_savings_mean", "relative_savings_median",
]


def activity_frequency(activity: DataFrame) -> DataFrame:
    """Share of earlier days with activity in the same hour: ``household_id, day, hour, p``."""
    earlier = (
        Window.partitionBy("household_id", "hour")
        .orderBy("day")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    hours = activity.select(
        "household_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "activity"
    )
    return hours.select("household_id", "day", "hour", F.avg("activity").over(earlier).alias("p"))


def usage_frequency(usage: DataFrame) -> DataFrame:
    """Share of earlier days on which the device was used: ``household_id, device, day, p``."""
    earlier = Window.partitionBy(*DEVICE).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return usage.select(*KEY, F.avg("usage").over(earlier).alias("p"))


def hour_probabilities(p_activity: DataFrame) -> DataFrame:
    """``household_id, day, p_activity``: probabilities of a day as a 24-vector."""
    return p_activity.groupBy("household_id", "day").agg(
        hour_vector("hour", "p").alias("p_activity")
    )


def day_inputs(
    profiles: DataFrame, prices: DataFrame, p_activity: DataFrame, p_usage: DataFrame
) -> DataFrame:
    """One row per household, device and day with all inputs of a recommendation.

    ``p_activity(household_id, day, hour, p)`` and ``p_usage(household_id, device, day, p)``
    may come from any model. ``reason`` names the first missing input; it is NULL when
    the row is complete.
    """
    rows = profiles.select(*KEY, "n_runs", profile_vector().alias("profile"))
    rows = rows.join(p_usage.select(*KEY, F.col("p").alias("p_usage")), KEY, "left")
    rows = rows.join(hour_probabilities(p_activity), ["household_id", "day"], "left")
    rows = attach(rows, stage(price_vectors(prices), "prices"), ["day"], "left")
    unknown_hour = F.col("p_activity").isNull() | F.exists("p_activity", lambda p: p.isNull())
    reason = (
        F.when(F.col("prices").isNull(), "missing prices")
        .when(unknown_hour, "missing activity probability")
        .when(F.col("p_usage").isNull(), "missing usage probability")
    )
    return rows.withColumn("reason", reason)


def input_errors(inputs: DataFrame) -> DataFrame:
    """Days without a recommendation and why (REC-3)."""
    return inputs.where(F.col("reason").isNotNull()).select(
        F.lit("recommendation").alias("agent"), *KEY, "reason"
    )


def with_costs(inputs: DataFrame) -> DataFrame:
    """Cost of the typical run per start hour, for complete rows (CST-1)."""
    return inputs.where(F.col("reason").isNull()).withColumn(
        "costs", start_costs("prices", "profile")
    )


def recommend(
    costed: DataFrame, activity_threshold: str | float, usage_threshold: str | float
) -> DataFrame:
    """Cheapest start among the hours likely to be active (REC-1, REC-2, REC-3).

    The thresholds are numbers or the names of columns that hold them.

    When no hour reaches the activity threshold the launch hour is 0 and the activity
    flag is set; a usage probability below its threshold sets the usage flag. Either
    flag makes ``recommendation`` NULL.
    """
    best = cheapest_hour("costs", "p_activity", str(activity_threshold))
    return (
        costed.withColumn("_best", best)
        .selectExpr(
            *costed.columns,
            "coalesce(_best.hour, 0) AS best_launch_hour",
            "CAST(_best IS NULL AS INT) AS no_recommend_flag_activity",
            f"CAST(p_usage < {usage_threshold} AS INT) AS no_recommend_flag_usage",
        )
        .withColumn(
            "recommendation",
            F.expr(
                "CASE WHEN no_recommend_flag_activity = 0 AND no_recommend_flag_usage = 0"
                " THEN best_launch_hour END"
            ),
        )
    )


RECOMMENDATION = [
    *KEY, "best_launch_hour", "no_recommend_flag_activity", "no_recommend_flag_usage",
    "recommendation",
]


def messages(recommended: DataFrame) -> DataFrame:
    """Recommendation text per device and day (REC-4, CST-3).

    Needs ``prices`` next to the recommendation columns.
    """
    hour = F.col("recommendation")
    start_prices = F.slice("prices", 1, 24)
    mean = F.aggregate(start_prices, F.lit(0.0), lambda a, x: a + x) / 24
    percent = saving_percent(F.get("prices", hour), mean)
    at = at_hour(F.col("day"), F.coalesce(hour, F.lit(0)))
    yes = F.concat(
        F.lit(MESSAGE_DEVICE), F.col("device"),
        F.lit(MESSAGE_DAY), F.date_format(at, MESSAGE_DATE_FORMAT),
        F.lit(MESSAGE_HOUR), F.date_format(at, MESSAGE_HOUR_FORMAT),
        F.lit(MESSAGE_REASON), percent.cast("string"), F.lit(MESSAGE_SHARE),
    )
    no = F.concat(F.lit(MESSAGE_NONE), F.col("device"), F.lit(" ."))
    return recommended.select(
        *KEY,
        "recommendation",
        percent.alias("saving_percent"),
        F.when(hour.isNotNull(), yes).otherwise(no).alias("message"),
    )


def day_starts(run_table: DataFrame) -> DataFrame:
    """Runs started on each day, as ``array<struct<hour, load>>`` ordered by hour (EVL-2).

    At most 12 runs fit in 24 hourly slots, so the array is short.
    """
    return run_table.groupBy(*DEVICE, F.to_date("start_ts").alias("day")).agg(
        F.array_sort(
            F.collect_list(F.struct(F.hour("start_ts").alias("hour"), F.col("load")))
        ).alias("starts")
    )


def with_truth(
    inputs: DataFrame, usage: DataFrame, activity: DataFrame, run_table: DataFrame
) -> DataFrame:
    """Add what really happened: use of the device, activity per hour, runs (JN-4, JN-7)."""
    active = activity.groupBy("household_id", F.to_date("ts").alias("day")).agg(
        hour_vector("hour(ts)", "activity").alias("activity_true")
    )
    return (
        inputs.join(usage.select(*KEY, F.col("usage").alias("usage_true")), KEY, "left")
        .join(day_starts(run_table), KEY, "left")
        .join(active, ["household_id", "day"], "left")
    )


def evaluate(recommended: DataFrame) -> DataFrame:
    """Acceptance, costs and savings of each recommendation (EVL-1..4, JN-6)."""
    out = recommended.withColumns(
        {
            "acceptable": F.expr("usage_true * get(activity_true, recommendation)"),
            "_run": nearest_start("starts", "recommendation"),
        }
    )
    # a day without a run has no start; its load is zero, and so is the cost of moving it
    out = out.withColumns(
        {
            "relevant_start": F.col("_run.hour"),
            "cost_no_recommendation": run_cost("prices", "_run.hour", "_run.load"),
            "cost_recommendation": F.when(
                F.col("recommendation").isNotNull(),
                F.coalesce(run_cost("prices", "recommendation", "_run.load"), F.lit(0.0)),
            ),
        }
    )
    savings = "cost_no_recommendation - cost_recommendation"
    return out.withColumns(
        {
            "savings": F.expr(savings),
            "relative_savings": F.expr(f"({savings}) / nullif(cost_no_recommendation, 0D)"),
        }
    ).drop("_run")


EVALUATION = [
    *KEY, "recommendation", "acceptable", "relevant_start", "cost_no_recommendation",
    "cost_recommendation", "savings", "relative_savings",
]


def _summary_sql(condition: str = "true") -> dict[str, str]:
    """Summary aggregates over the rows that meet a condition."""
    when = lambda value: f"CASE WHEN {condition} THEN {value} END"
    return {
        "n_recommendations": f"count({when('recommendation')})",
        "acceptable": f"avg({when('acceptable')})",
        "total_savings": f"sum({when('acceptable * savings')})",
        "relative_savings_mean": f"avg({when('relative_savings')})",
        "relative_savings_median": f"median({when('relative_savings')})",
    }


def summarise(evaluated: DataFrame, by: list[str]) -> DataFrame:
    """Counts, acceptance and savings per group (EVL-5, AGG-3).

    The exact median keeps the values of one household and threshold pair, which is
    limited by its devices and days.
    """
    return evaluated.groupBy(*by).agg(
        *[F.expr(sql).alias(name) for name, sql in _summary_sql().items()]
    )


def threshold_grid(
    costed_with_truth: DataFrame,
    activity_thresholds: tuple[float, ...] = GRID_THRESHOLDS,
    usage_thresholds: tuple[float, ...] = GRID_THRESHOLDS,
) -> DataFrame:
    """Summary per household and threshold pair in one job (EVL-6, JN-8).

    Costs are computed once. The activity thresholds are exploded from a literal array,
    since each may choose another hour. A usage threshold only drops recommendations, so
    all usage thresholds are conditional aggregates of the same rows. Nothing is
    joined or shuffled before the one aggregate.
    """
    lits = F.array(*[F.lit(float(x)) for x in activity_thresholds])
    per_activity = recommend(
        costed_with_truth.withColumn("activity_threshold", F.explode(lits)),
        "activity_threshold",
        0.0,
    )
    scored = evaluate(per_activity).select(
        "household_id", "activity_threshold", "p_usage",
        "recommendation", "acceptable", "savings", "relative_savings",
    )
    per_usage = {i: _summary_sql(f"p_usage >= {float(u)}D") for i, u in enumerate(usage_thresholds)}
    wide = scored.groupBy("household_id", "activity_threshold").agg(
        *[F.expr(sql).alias(f"{name}_{i}") for i, part in per_usage.items() for name, sql in part.items()]
    )
    structs = ", ".join(
        f"named_struct('usage_threshold', {float(u)}D, "
        + ", ".join(f"'{name}', {name}_{i}" for name in per_usage[i]) + ")"
        for i, u in enumerate(usage_thresholds)
    )
    return wide.selectExpr("household_id", "activity_threshold", f"inline(array({structs}))")


def sensitivity(
    grid: DataFrame, target: str, usage_thresholds: tuple[float, ...] = GRID_THRESHOLDS
) -> DataFrame:
    """Matrix of one summary column, activity by usage threshold (EVL-7, AGG-8)."""
    if target not in SUMMARY:
        raise ValueError(f"unknown target {target!r}")
    wide = (
        grid.groupBy("household_id", "activity_threshold")
        .pivot("usage_threshold", list(usage_thresholds))
        .agg(F.first(target))
    )
    return wide.select(
        "household_id",
        "activity_threshold",
        *[
            F.col(f"`{t}`").alias(f"usage_{str(t).replace('.', '_')}")
            for t in usage_thresholds
        ],
    )


def optimal_thresholds(grid: DataFrame) -> DataFrame:
    """Pair with the highest total savings per household; the last pair wins ties (EVL-8, TOP-1).

    Totals are compared to 6 digits, so that the order of a sum cannot break a tie.
    """
    rank = F.struct(
        F.coalesce(F.round("total_savings", 6), F.lit(float("-inf"))),
        F.col("activity_threshold"),
        F.col("usage_threshold"),
    )
    row = F.struct(*[c for c in grid.columns if c != "household_id"])
    best = grid.groupBy("household_id").agg(F.max_by(row, rank).alias("_row"))
    out = best.select("household_id", "_row.*")
    key = F.concat(
        F.lit("activity: "), F.col("activity_threshold").cast("string"),
        F.lit("; usage: "), F.col("usage_threshold").cast("string"),
    )
    return out.withColumn("threshold_key", key)


def recommendation_hours(evaluated: DataFrame, by: list[str]) -> DataFrame:
    """How often each hour is recommended (AGG-9)."""
    return (
        evaluated.where(F.col("recommendation").isNotNull())
        .groupBy(*by, "recommendation")
        .agg(F.count(F.lit(1)).alias("n"))
    )
