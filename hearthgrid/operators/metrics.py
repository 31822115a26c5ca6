"""Scores of models, profiles and explanations (MET-*, WIN-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthgrid.functions.exprs import within
from hearthgrid.operators.prefix import running_totals
from hearthgrid.operators.runs import DEVICE, HOURS


def auc(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Area under the ROC curve with half credit for ties (MET-1); one class only gives NULL.

    Rows are first reduced to positives and negatives per distinct score. Running
    totals over ranges of scores replace a global sort, so one key may hold all rows.
    """
    groups = keys or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(0))
    known = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    counts = known.groupBy(*groups, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    ranked = running_totals(counts, groups, score, ["pos", "neg"])
    beaten = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    pairs = F.first("pos_total") * F.first("neg_total")
    out = ranked.groupBy(*groups).agg(
        F.when(pairs > 0, beaten / F.nullif(pairs, F.lit(0))).alias("auc")
    )
    return out if keys else out.drop("_all")


def load_mse(run_table: DataFrame, profiles: DataFrame) -> DataFrame:
    """Mean squared error of profiles against true runs per device (MET-2).

    A run on a day without a profile is compared with zeros.
    """
    on_day = run_table.withColumn("day", F.to_date("start_ts"))
    pairs = on_day.join(profiles.select(*DEVICE, "day", *HOURS), [*DEVICE, "day"], "left")
    squares = " + ".join(f"pow(load[{i}] - coalesce({h}, 0D), 2)" for i, h in enumerate(HOURS))
    error = F.expr(f"({squares}) / {len(HOURS)}")
    return pairs.groupBy(*DEVICE).agg(F.avg(error).alias("mse"), F.count(F.lit(1)).alias("n_runs"))


def profile_distance(profiles: DataFrame) -> DataFrame:
    """Normalised euclidean distance of each day's profile to the last one (MET-3)."""
    last = profiles.groupBy(*DEVICE).agg(
        F.max_by(F.struct(*HOURS), F.col("day")).alias("_last")
    )
    rows = profiles.join(last, DEVICE)
    diff = " + ".join(f"pow({h} - _last.{h}, 2)" for h in HOURS)
    size = " + ".join(f"pow(_last.{h}, 2)" for h in HOURS)
    return rows.selectExpr(
        *DEVICE, "day", f"sqrt({diff}) / nullif(sqrt({size}), 0D) AS distance"
    )


def fidelity(
    df: DataFrame, keys: list[str], model: str, surrogate: str, threshold: float = 0.5
) -> DataFrame:
    """AUC of the surrogate's decisions against the model's decisions (MET-5)."""
    flags = df.select(
        *keys,
        (F.col(model) > threshold).cast("int").alias("_model"),
        (F.col(surrogate) > threshold).cast("double").alias("_surrogate"),
    )
    return auc(flags, keys, "_model", "_surrogate").withColumnRenamed("auc", "fidelity")


def confusion_scores(
    df: DataFrame, keys: list[str], model: str, surrogate: str, threshold: float = 0.5
) -> DataFrame:
    """Accuracy, precision and recall of the surrogate's decisions (MET-9)."""
    m, s = F.col(model) > threshold, F.col(surrogate) > threshold
    ratio = lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(F.lit(0.0))
    tp, fp, fn = F.count_if(m & s), F.count_if(~m & s), F.count_if(m & ~s)
    both = F.count_if(m == s)
    return df.groupBy(*keys).agg(
        ratio(both, F.count_if(m.isNotNull() & s.isNotNull())).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
    )


def surrogate_errors(df: DataFrame, keys: list[str], model: str, surrogate: str) -> DataFrame:
    """Mean absolute difference, squared mean difference and mean square (MET-6, MET-10)."""
    d = F.col(model) - F.col(surrogate)
    return df.groupBy(*keys).agg(
        F.avg(F.abs(d)).alias("maee"),
        F.pow(F.avg(d), F.lit(2.0)).alias("msee"),
        F.avg(d * d).alias("mse"),
    )


def explanation_scores(
    df: DataFrame, keys: list[str], label: str, model: str, surrogate: str, threshold: float = 0.5
) -> DataFrame:
    """All explanation scores side by side (XAI-8)."""
    out = auc(df, keys, label, surrogate).withColumnRenamed("auc", "auc_true")
    for part in (
        fidelity(df, keys, model, surrogate, threshold),
        surrogate_errors(df, keys, model, surrogate),
        confusion_scores(df, keys, model, surrogate, threshold),
    ):
        out = out.join(part, keys)
    return out


def cold_start_days(
    scores: DataFrame, keys: list[str], tolerances: list[float], lower_is_better: Column
) -> DataFrame:
    """First day from which all later scores stay within tolerance (WIN-4).

    ``scores`` has one row per key and ``day`` with ``score``. A score to maximise must
    stay above ``max * (1 - tolerance)``, a distance must stay below the tolerance; an
    unknown score violates. Without a stable day the result is the number of days + 1.
    """
    w = Window.partitionBy(*keys)
    numbered = scores.withColumns(
        {
            "_rn": F.row_number().over(w.orderBy("day")),
            "_max": F.max("score").over(w),
            "_lower": lower_is_better,
        }
    )
    at = numbered.withColumn(
        "tolerance", F.explode(F.array(*[F.lit(float(t)) for t in tolerances]))
    )
    ok = F.when(F.col("_lower"), F.col("score") < F.col("tolerance")).otherwise(
        F.col("score") > F.col("_max") * (1 - F.col("tolerance"))
    )
    violates = ~F.coalesce(ok, F.lit(False))
    return at.groupBy(*keys, "tolerance").agg(
        (F.coalesce(F.max(F.when(violates, F.col("_rn"))), F.lit(0)) + 1).alias("cold_start_days")
    )


def cold_start_table(
    days: DataFrame, keys: list[str], tolerances: list[float]
) -> DataFrame:
    """One row per key with the cold-start days of every tolerance side by side (EVL-9)."""
    wide = days.groupBy(*keys).pivot("tolerance", tolerances).agg(F.first("cold_start_days"))
    return wide.select(
        *keys, *[F.col(f"`{t}`").alias(f"days_{str(t).replace('.', '_')}") for t in tolerances]
    )


def framework_days(days: DataFrame, by: list[str]) -> DataFrame:
    """The whole framework is ready when its slowest agent is (AGG-5)."""
    return days.groupBy(*by, "tolerance").agg(F.max("cold_start_days").alias("framework"))


def score_table(scores: DataFrame, metric: str, positions: int) -> DataFrame:
    """Household by device position table of one score (MET-8, AGG-8).

    ``scores`` has ``household_id, device, <metric>``; positions follow the device name. A
    household with more devices than ``positions`` is an error.
    """
    w = Window.partitionBy("household_id").orderBy("device")
    wide = (
        scores.withColumn("_pos", within(F.row_number().over(w) - 1, positions))
        .groupBy("household_id")
        .pivot("_pos", list(range(positions)))
        .agg(F.first(metric))
    )
    return wide.select(
        "household_id", *[F.col(f"`{i}`").alias(f"device_{i}") for i in range(positions)]
    )
