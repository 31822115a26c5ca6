"""Recommendations together with the reasons for them (XAI-5..7 at the recommended hour)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthgrid.config import WEATHER_COLUMNS
from hearthgrid.operators import explain, sentences
from hearthgrid.plans.decide import KEY
from hearthgrid.session import stage


def _moments(recommended: DataFrame) -> DataFrame:
    """Recommendations with ``ts``, the hour that the explanation is about."""
    start = F.make_dt_interval(F.lit(0), F.col("best_launch_hour"))
    return recommended.withColumn("ts", F.col("day").cast("timestamp_ntz") + start)


def at_recommended_hour(recommended: DataFrame, attributions: DataFrame) -> DataFrame:
    """Attributions ``household_id, ts, feature, attribution`` of each recommendation's hour with their rank."""
    hours = _moments(recommended).select(*KEY, "best_launch_hour", "ts")
    return explain.importance(hours.join(attributions, ["household_id", "ts"]), KEY)


def with_unscaled(attributions: DataFrame, weather: DataFrame, ts: Column) -> DataFrame:
    """Attributions with ``unscaled``: the stored reading behind a weather feature at the time ``ts``, or the model's own value without one.

    ``weather`` has one row for each hour or day.
    """
    columns = [c for c in weather.columns if c in WEATHER_COLUMNS]
    long = weather.unpivot(["ts"], columns, "feature", "_stored").withColumnRenamed("ts", "_at")
    joined = attributions.withColumn("_at", ts).join(stage(long, "unscaled"), ["_at", "feature"], "left").drop("_at")
    own = F.when(F.col("feature").isin(*columns), F.col("value"))
    return joined.withColumn("unscaled", F.coalesce("_stored", own)).drop("_stored")


def with_sentences(recommended: DataFrame, activity: DataFrame, usage: DataFrame) -> DataFrame:
    """Recommendations with a sentence on the activity at their hour and one on the use of the device.

    ``activity`` holds attributions by ``household_id, ts``, ``usage`` by ``household_id, device, day``, both with the
    column ``unscaled`` for the weather. Only the recommended hours are put into words. A sentence is NULL where
    the features of its model are not known.
    """
    moments = _moments(recommended).select(*KEY, "best_launch_hour", "recommendation", "ts")
    wanted = moments.select("household_id", "ts").distinct()
    spoken = sentences.activity_sentences(
        activity.join(wanted, ["household_id", "ts"], "left_semi"), ["household_id", "ts"]
    ).withColumnRenamed("sentence", "activity_sentence")
    used = sentences.usage_sentences(
        usage.join(moments.select(*KEY).distinct(), KEY, "left_semi"), KEY
    ).withColumnRenamed("sentence", "usage_sentence")
    return moments.join(spoken, ["household_id", "ts"], "left").join(used, KEY, "left").drop("ts")
