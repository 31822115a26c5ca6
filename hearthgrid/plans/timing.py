"""Seconds per explained day (MET-7)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgrid.session import stage


def task_seconds(spark: SparkSession, group: str) -> float:
    """Run time of all tasks of a job group, as the application's own records have it."""
    context = spark.sparkContext
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in getattr(tracker.getJobInfo(job), "stageIds", ())}
    total = 0
    for number in stages:
        try:
            total += store.lastStageAttempt(number).executorRunTime()
        except Py4JJavaError:
            continue  # a stage that was planned and never ran
    return total / 1000.0


def seconds_per_day(spark: SparkSession, agent: str, method: str, explain: Callable[[], DataFrame], day: str = "day") -> DataFrame:
    """``agent, method, day, instances, seconds`` of the jobs that ``explain`` and its result take.

    All days are explained together, so a day gets its share of the task seconds by its number of explained rows.
    """
    context = spark.sparkContext
    group = uuid.uuid4().hex
    context.setJobGroup(group, f"{agent} {method}")
    try:
        explained = stage(explain(), "explained")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    seconds = task_seconds(spark, group)
    days = explained.groupBy(F.col(day).alias("day")).agg(F.count("*").alias("instances"))
    total = explained.count()
    return days.select(
        F.lit(agent).alias("agent"), F.lit(method).alias("method"), "day", "instances",
        (F.col("instances") * (seconds / max(total, 1))).alias("seconds"),
    )
