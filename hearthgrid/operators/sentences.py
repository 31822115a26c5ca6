"""Sentences that explain a recommendation (XAI-6, XAI-7, TOP-2).

Attributions come in long form, one row per feature of an instance; conditional
aggregates turn them into one row per instance with everything a sentence needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthgrid.config import WEATHER_LABELS, WEEKDAY_DUMMIES

# Wording of the explanations.
OPENING = "We based the recommendation on your past activity and usage of the device. "
LAG_WORDS = {24: "day", 48: "two days", 72: "three days"}
ACTIVE_TODAY = "We believe you are active today since you were "
ACTIVE_DURING = "active during the last "
ONE_WEATHER = "The weather condition ("
TWO_WEATHER = "The weather conditions ("
WEATHER_END = ") support that recommendation."
WEEKDAY_AND_HOUR = "The weekday and hour strenghtens that prediction."
WEEKDAY_ONLY = "The weekday strenghtens that prediction."
HOUR_ONLY = "The hour strenghtens that prediction."
LIKELY_USE = "We believe you are likely to use the device in the near future since you were "
USED_DURING = " and have used the device in the last "
TWO_DAYS_BACK = "active during the last 2 days"
NOT = "not "


def _of(feature: str, column: str) -> Column:
    return F.max(F.when(F.col("feature") == feature, F.col(column)))


def _strongest(pairs: list[tuple[Column, Column]]) -> Column:
    """Text of the largest attribution, NULL when all are negative; the first wins ties."""
    ranked = F.array(
        *[
            F.struct(a.alias("a"), F.lit(-i).alias("i"), text.alias("text"))
            for i, (a, text) in enumerate(pairs)
        ]
    )
    best = F.array_max(F.filter(ranked, lambda s: s["a"].isNotNull()))
    return F.when(best["a"] >= 0, best["text"])


def _weather_clause(features: list[str]) -> Column:
    """Up to two weather features with the largest attributions that are not negative."""
    ranked = F.filter(
        F.array(
            *[
                F.struct(
                    (-F.col(f"_a_{f}")).alias("a"),
                    F.lit(i).alias("i"),
                    F.concat(
                        F.lit(f"{WEATHER_LABELS[f]}:"), F.round(F.col(f"_v_{f}"), 2).cast("string")
                    ).alias("text"),
                )
                for i, f in enumerate(features)
            ]
        ),
        lambda s: (s["a"] <= 0) & s["text"].isNotNull(),
    )
    top = F.transform(F.slice(F.array_sort(ranked), 1, 2), lambda s: s["text"])
    one = F.concat(F.lit(ONE_WEATHER), F.get(top, F.lit(0)), F.lit(WEATHER_END))
    two = F.concat(F.lit(TWO_WEATHER), F.concat_ws(", ", top), F.lit(WEATHER_END))
    return F.when(F.size(top) == 2, two).when(F.size(top) == 1, one).otherwise("")


def _weather_columns(features: list[str]) -> list[Column]:
    return [_of(f, "attribution").alias(f"_a_{f}") for f in features] + [
        _of(f, "unscaled").alias(f"_v_{f}") for f in features
    ]


def activity_sentences(attributions: DataFrame, ids: list[str]) -> DataFrame:
    """Sentence for the activity model (XAI-6): ``ids, sentence``.

    ``attributions`` has ``feature, value, attribution, unscaled``; ``unscaled`` is the weather
    reading behind a scaled weather feature. The lag with the largest attribution names the
    period; "not" is added when no lag was active. The weekday is mentioned when any
    weekday feature supports the prediction.
    """
    weather = sorted(WEATHER_LABELS)
    lags = list(LAG_WORDS)
    weekdays = [f"day_name_{d}" for d in WEEKDAY_DUMMIES]
    one = attributions.groupBy(*ids).agg(
        *[_of(f"activity_lag_{k}", "attribution").alias(f"_lag_{k}") for k in lags],
        *[_of(f"activity_lag_{k}", "value").alias(f"_was_{k}") for k in lags],
        _of("hour", "attribution").alias("_hour"),
        F.max(F.when(F.col("feature").isin(*weekdays), F.col("attribution"))).alias("_weekday"),
        *_weather_columns(weather),
    )
    idle = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"_was_{k}"), F.lit(0.0)) == 0 for k in lags])
    period = _strongest([(F.col(f"_lag_{k}"), F.lit(word)) for k, word in LAG_WORDS.items()])
    past = F.when(
        period.isNotNull(),
        F.concat(
            F.lit(ACTIVE_TODAY), F.when(idle, NOT).otherwise(""), F.lit(ACTIVE_DURING), period,
            F.lit("."),
        ),
    ).otherwise("")
    by_day = F.coalesce(F.col("_weekday") >= 0, F.lit(False))
    by_hour = F.coalesce(F.col("_hour") >= 0, F.lit(False))
    when = (
        F.when(by_day & by_hour, WEEKDAY_AND_HOUR)
        .when(by_day, WEEKDAY_ONLY)
        .when(by_hour, HOUR_ONLY)
        .otherwise("")
    )
    return one.select(
        *ids, F.concat(F.lit(OPENING), past, _weather_clause(weather), when).alias("sentence")
    )


def usage_sentences(attributions: DataFrame, ids: list[str]) -> DataFrame:
    """Sentence for the usage model (XAI-7): ``ids, sentence``."""
    weather = sorted(WEATHER_LABELS)
    one = attributions.groupBy(*ids).agg(
        _of("usage_lag_1", "attribution").alias("_lag_1"),
        _of("usage_lag_2", "attribution").alias("_lag_2"),
        _of("active_last_2_days", "value").alias("_active"),
        *_weather_columns(weather),
    )
    period = _strongest([(F.col("_lag_1"), F.lit("day")), (F.col("_lag_2"), F.lit("two days"))])
    used = F.when(
        period.isNotNull(), F.concat(F.lit(USED_DURING), period)
    ).otherwise("")
    return one.select(
        *ids,
        F.concat(
            F.lit(LIKELY_USE),
            F.when(F.coalesce(F.col("_active"), F.lit(0.0)) == 0, NOT).otherwise(""),
            F.lit(TWO_DAYS_BACK), used, F.lit("."),
            _weather_clause(weather),
        ).alias("sentence"),
    )
