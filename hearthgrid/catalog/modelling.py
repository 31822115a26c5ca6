"""Queries on splits, models, walk-forward scoring and explanations."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgrid.catalog import views as V
from hearthgrid.catalog.decisions import Prepared
from hearthgrid.catalog.registry import query, rounded
from hearthgrid.config import WEATHER_COLUMNS, WEEKDAY_DUMMIES
from hearthgrid.models import attributions, cells, per_entity, pooled, search, splits
from hearthgrid.operators import explain, metrics, sentences
from hearthgrid.plans import decide, prepare, timing
from hearthgrid.session import stage

LAGS = ["activity_lag_24", "activity_lag_48", "activity_lag_72"]
DAYS = [f"day_name_{d}" for d in WEEKDAY_DUMMIES]
WEATHER = list(WEATHER_COLUMNS)
USAGE_IDS = ["household_id", "device", "day"]
ACTIVITY_COLUMNS = ["hour", *LAGS, *DAYS]
USAGE_COLUMNS = ["usage_lag_1", "usage_lag_2", "active_last_2_days", *WEATHER]


def activity_frame(spark, d, weather: bool = False) -> DataFrame:
    """Feature rows with known lags."""
    t = Prepared(spark, d)
    frame = prepare.activity_features(t.hourly, V.CONFIG, V.weather(spark, d) if weather else None)
    return frame.withColumn("day", F.to_date("ts")).na.drop(subset=LAGS)


def usage_frame(spark, d) -> DataFrame:
    t = Prepared(spark, d)
    frame = prepare.usage_features(t.hourly, V.CONFIG, V.weather(spark, d))
    return frame.na.drop(subset=["usage_lag_1", "usage_lag_2"])


def train_test(spark, d, weather: bool = False) -> tuple[DataFrame, DataFrame]:
    rows = stage(activity_frame(spark, d, weather), "features")
    return rows.where(F.col("day") < "2024-01-22"), rows.where(F.col("day") >= "2024-01-22")


def daily(spark, d, model_type: str, weather: bool = False, **params) -> DataFrame:
    """Scores of all days by a model of each household that is refitted every day."""
    columns = ACTIVITY_COLUMNS + (WEATHER if weather else [])
    return per_entity.walk_forward(
        activity_frame(spark, d, weather), ["household_id"], "ts", columns, "activity", model_type, **params
    )


def scored(spark, d, model_type: str, weather: bool = False, **params) -> DataFrame:
    out = daily(spark, d, model_type, weather, **params).where(F.col("p").isNotNull())
    return out.select("household_id", "ts", F.col("label").cast("int").alias("activity"), "p")


def test_and_train_auc(predictions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """AUC over all scored days and mean AUC on the training data of the days."""
    out = stage(predictions, "predictions")
    test = metrics.auc(out, keys, "label", "p").withColumnRenamed("auc", "auc_test")
    return test.join(per_entity.mean_train_auc(out, keys, order), keys)


# --- splits --------------------------------------------------------------------------

SPLIT_SQL = (
    "SELECT household_id, {cols}, 'train' AS part FROM {src} WHERE {t} < DATE '2024-01-20'"
    " AND {t} >= DATE '2024-01-05' UNION ALL SELECT household_id, {cols}, 'test' FROM {src}"
    " WHERE {t} = DATE '2024-01-20'"
)


def _parts(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    return train.select(*columns, F.lit("train").alias("part")).unionByName(
        test.select(*columns, F.lit("test").alias("part"))
    )


@query(
    "spl1_split",
    SPLIT_SQL.format(cols="ts, activity", src="activity", t="CAST(ts AS DATE)"),
)
def spl1_split(spark, d):
    rows = Prepared(spark, d).activity()
    return _parts(
        *splits.activity_split(rows, "2024-01-20", "2024-01-05"),
        ["household_id", "ts", "activity"],
    )


@query("spl2_split", SPLIT_SQL.format(cols="device, day, usage", src="usage", t="day"))
def spl2_split(spark, d):
    rows = Prepared(spark, d).usage()
    return _parts(
        *splits.usage_split(rows, "2024-01-20", "2024-01-05"),
        ["household_id", "device", "day", "usage"],
    )


@query(
    "spl2_split_with_test_day",
    SPLIT_SQL.format(cols="device, day, usage", src="usage", t="day").replace(
        "< DATE '2024-01-20'", "<= DATE '2024-01-20'"
    ),
)
def spl2_split_with_test_day(spark, d):
    rows = Prepared(spark, d).usage()
    return _parts(
        *splits.usage_split(rows, "2024-01-20", "2024-01-05", leak_free=False),
        ["household_id", "device", "day", "usage"],
    )


_FILL = (
    "first_value(w.{c} IGNORE NULLS) OVER (PARTITION BY {k} ORDER BY {o}"
    " ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}"
)
ACTIVITY_FEATURES_SQL = (
    "(SELECT l.household_id, l.ts, l.hour, lag24 AS activity_lag_24, lag48 AS activity_lag_48,"
    " lag72 AS activity_lag_72, "
    + ", ".join(f"CAST(dayname(l.ts) = '{w}' AS INT) AS day_name_{w}" for w in WEEKDAY_DUMMIES)
    + ", " + ", ".join(_FILL.format(c=c, k="l.household_id", o="l.ts") for c in WEATHER)
    + " FROM activity_lags l LEFT JOIN weather w ON l.ts = w.ts QUALIFY lag72 IS NOT NULL)"
)
_WEATHER_KNOWN = " AND ".join(f"{c} IS NOT NULL" for c in WEATHER)


# --- models --------------------------------------------------------------------------


KNN_SQL = (
    "SELECT household_id, ts, round(avg(label), 6) AS p FROM"
    " (SELECT a.household_id, a.ts, b.activity AS label FROM f a JOIN f b"
    "  ON a.household_id = b.household_id AND CAST(b.ts AS DATE) < CAST(a.ts AS DATE)"
    "  QUALIFY row_number() OVER (PARTITION BY a.household_id, a.ts ORDER BY"
    "   (a.hour - b.hour) * (a.hour - b.hour) + (a.lag24 - b.lag24) * (a.lag24 - b.lag24)"
    "   + (a.lag48 - b.lag48) * (a.lag48 - b.lag48) + (a.lag72 - b.lag72) * (a.lag72 - b.lag72)"
    "   + CASE WHEN a.wd = b.wd THEN 0 WHEN a.wd = 4 OR b.wd = 4 THEN 1 ELSE 2 END, b.ts) <= 10)"
    " GROUP BY household_id, ts".replace(
        " f a", " (SELECT * FROM activity_lags WHERE lag72 IS NOT NULL) a"
    ).replace(" f b", " (SELECT * FROM activity_lags WHERE lag72 IS NOT NULL) b")
)


@query("mdl5_knn", KNN_SQL)
def mdl5_knn(spark, d):
    rows = activity_frame(spark, d)
    out = per_entity.walk_forward(
        rows, ["household_id"], "ts", ACTIVITY_COLUMNS, "activity", "knn", n_neighbors=10
    )
    known = out.where(F.col("p").isNotNull())
    return rounded(known.select("household_id", "ts", "p"))


_NEAR_ROWS = f"(SELECT f.*, l.wd, l.activity FROM {ACTIVITY_FEATURES_SQL} f JOIN activity_lags l USING (household_id, ts) WHERE {_WEATHER_KNOWN})"


@query(
    "mdl5_knn_weather",
    "SELECT household_id, ts, round(avg(label), 6) AS p FROM"
    " (SELECT a.household_id, a.ts, b.activity AS label FROM"
    f" {_NEAR_ROWS} a JOIN {_NEAR_ROWS} b ON a.household_id = b.household_id AND CAST(b.ts AS DATE) < CAST(a.ts AS DATE)"
    "  QUALIFY row_number() OVER (PARTITION BY a.household_id, a.ts ORDER BY "
    + " + ".join(f"power(a.{c} - b.{c}, 2)" for c in ["hour", *LAGS, *WEATHER])
    + "   + CASE WHEN a.wd = b.wd THEN 0 WHEN a.wd = 4 OR b.wd = 4 THEN 1 ELSE 2 END, b.ts) <= 10)"
    " GROUP BY household_id, ts",
)
def mdl5_knn_weather(spark, d):
    """Nearest neighbours on real-valued features, by an index that takes the rows of each day."""
    out = daily(spark, d, "knn", weather=True, n_neighbors=10)
    return rounded(out.where(F.col("p").isNotNull()).select("household_id", "ts", "p"))


@query("mdl1_logit")
def mdl1_logit(spark, d):
    return scored(spark, d, "logit")


@query("mdl2_rf")
def mdl2_rf(spark, d):
    return scored(spark, d, "random forest")


@query("mdl3_gbt")
def mdl3_gbt(spark, d):
    return scored(spark, d, "xgboost")


SPLIT_LAMBDA, SPLIT_ALPHA = 0.5, 2.0
_SPLIT_FEATURES = {
    "hour": "hour", "activity_lag_24": "lag24", "activity_lag_48": "lag48", "activity_lag_72": "lag72",
    **{f"day_name_{w}": f"CAST(dayname(ts) = '{w}' AS INT)" for w in WEEKDAY_DUMMIES},
}
_Q = f"power(greatest(abs({{g}}) - {SPLIT_ALPHA}, 0), 2) / ({{h}} + {SPLIT_LAMBDA})"
_W = f"round(-sign({{g}}) * greatest(abs({{g}}) - {SPLIT_ALPHA}, 0) / ({{h}} + {SPLIT_LAMBDA}), 9)"


@query(
    "mdl3_split_gains",
    # at a score of 1/2 a row has the derivatives 1/2 - y and 1/4
    "SELECT feature, (v + above) / 2 AS threshold, round({gain}, 6) AS gain, {left} AS left_value, {right} AS right_value FROM"
    " (SELECT feature, v, lead(v) OVER o AS above, sum(g) OVER o AS gl, sum(h) OVER o AS hl,"
    " sum(g) OVER (PARTITION BY feature) AS g, sum(h) OVER (PARTITION BY feature) AS h FROM (".format(
        gain=_Q.format(g="gl", h="hl") + " + " + _Q.format(g="(g - gl)", h="(h - hl)") + " - " + _Q.format(g="g", h="h"),
        left=_W.format(g="gl", h="hl"), right=_W.format(g="(g - gl)", h="(h - hl)"),
    )
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({x} AS DOUBLE) AS v, sum(0.5 - activity) AS g, count(*) / 4.0 AS h FROM activity_lags"
        " WHERE lag72 IS NOT NULL GROUP BY ALL"
        for c, x in _SPLIT_FEATURES.items()
    )
    + ") WINDOW o AS (PARTITION BY feature ORDER BY v)) WHERE above IS NOT NULL",
)
def mdl3_split_gains(spark, d):
    """Gain and leaf values of every first split of penalised boosting, from the written cells."""
    table = cells.CellTable.of(activity_frame(spark, d), ACTIVITY_COLUMNS, "activity")
    gains = cells.first_splits(table, ACTIVITY_COLUMNS, SPLIT_LAMBDA, SPLIT_ALPHA)
    return rounded(gains, 9, gain=6)


@query("mdl3_first_tree")
def mdl3_first_tree(spark, d):
    """First split that one round of penalised boosting takes, with its leaf values."""
    rows = activity_frame(spark, d)
    model = cells.fit_boosting(
        rows, ACTIVITY_COLUMNS, "activity", 1.0, 1, 1, reg_lambda=SPLIT_LAMBDA, reg_alpha=SPLIT_ALPHA
    )
    return spark.createDataFrame(
        [r for r in model.splits()], "tree int, feature string, threshold double, left_value double, right_value double"
    )


@query("mdl4_ada")
def mdl4_ada(spark, d):
    return scored(spark, d, "ada")


@query("mdl6_additive")
def mdl6_additive(spark, d):
    return scored(spark, d, "ebm", weather=True)


@query("mdl9_walk_forward")
def mdl9_walk_forward(spark, d):
    """Test and training AUC per household with a logistic model refitted every day."""
    return test_and_train_auc(daily(spark, d, "logit"), ["household_id"], "ts")


@query("mdl9_walk_forward_forest")
def mdl9_walk_forward_forest(spark, d):
    """The same with a random forest of 500 trees for every household and day."""
    return test_and_train_auc(daily(spark, d, "random forest"), ["household_id"], "ts")


@query("mdl9_walk_forward_boosting")
def mdl9_walk_forward_boosting(spark, d):
    """The same with 100 rounds of penalised boosting for every household and day."""
    return test_and_train_auc(daily(spark, d, "xgboost"), ["household_id"], "ts")


@query("mdl9_walk_forward_ada")
def mdl9_walk_forward_ada(spark, d):
    """The same with 100 boosted stumps for every household and day."""
    return test_and_train_auc(daily(spark, d, "ada"), ["household_id"], "ts")


@query("mdl9_walk_forward_additive")
def mdl9_walk_forward_additive(spark, d):
    """The same with shape functions and pair interactions for every household and day, with the weather."""
    return test_and_train_auc(daily(spark, d, "ebm", weather=True), ["household_id"], "ts")


def daily_usage(spark, d, model_type: str = "logit", **params) -> DataFrame:
    """Scores of all days by a model of each household and device that is refitted every day, with the weather."""
    return per_entity.walk_forward(
        usage_frame(spark, d), USAGE_IDS[:2], "day", USAGE_COLUMNS, "usage", model_type, **params
    )


@query("mdl9_walk_forward_usage")
def mdl9_walk_forward_usage(spark, d):
    """Device usage, one logistic model per household and device (EVL-10)."""
    return test_and_train_auc(daily_usage(spark, d), USAGE_IDS[:2], "day")


@query("mdl9_walk_forward_usage_boosting")
def mdl9_walk_forward_usage_boosting(spark, d):
    """Device usage by penalised boosting."""
    return test_and_train_auc(daily_usage(spark, d, "xgboost"), USAGE_IDS[:2], "day")


@query("mdl9_walk_forward_pooled")
def mdl9_walk_forward_pooled(spark, d):
    """A model for each week, fitted on all days before it."""
    rows = stage(activity_frame(spark, d), "features")
    out, _, _ = pooled.walk_forward(
        rows, pooled.folds(rows, "day", "week"), "day", ACTIVITY_COLUMNS, "activity", "logit"
    )
    return metrics.auc(out, ["household_id", "fold"], "activity", "p")


@query("mdl10_predictions")
def mdl10_predictions(spark, d):
    """Daily predictions of both agents in one long table."""
    activity = daily(spark, d, "logit").select(F.lit("activity").alias("agent"), "household_id",
             F.lit(None).cast("string").alias("device"), "ts", "label", "p")
    usage = daily_usage(spark, d).select(F.lit("usage").alias("agent"), "household_id", "device",
             F.col("day").cast("timestamp_ntz").alias("ts"), "label", "p")
    return activity.unionByName(usage)


@query("rec2_model_recommend")
def rec2_model_recommend(spark, d):
    """Recommendations from the daily refitted models of each household."""
    t = Prepared(spark, d)
    frame = prepare.activity_features(t.hourly, V.CONFIG).na.drop(subset=LAGS)
    active = per_entity.walk_forward(
        frame, ["household_id"], "ts", ACTIVITY_COLUMNS, "activity"
    ).select("household_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "p")
    daily = prepare.usage_features(t.hourly, V.CONFIG).na.drop(subset=["usage_lag_2"])
    used = per_entity.walk_forward(
        daily, ["household_id", "device"], "day",
        ["usage_lag_1", "usage_lag_2", "active_last_2_days"], "usage",
    ).select("household_id", "device", "day", "p")
    inputs = decide.day_inputs(t.profiles(), t.prices(), active, used)
    return decide.recommend(decide.with_costs(inputs), 0.25, 0.375).select(*decide.RECOMMENDATION)


def cold_starts(spark, d, model_type: str = "logit", **params) -> DataFrame:
    """AUC on the whole period of the models of each day: ``agent, household_id, device, day, score``."""
    activity = per_entity.cold_start(
        activity_frame(spark, d), ["household_id"], "ts", ACTIVITY_COLUMNS, "activity", model_type, **params
    )
    usage = per_entity.cold_start(
        usage_frame(spark, d), USAGE_IDS[:2], "day", USAGE_COLUMNS, "usage", model_type, **params
    )
    none = F.lit(None).cast("string").alias("device")
    return activity.select(F.lit("activity").alias("agent"), "household_id", none, "day", "score").unionByName(
        usage.select(F.lit("usage").alias("agent"), "household_id", "device", "day", "score")
    )


@query("mdl11_cold_start")
def mdl11_cold_start(spark, d):
    """A model of each household (and device) for each day of the period, fitted on all days before it, of both agents."""
    return cold_starts(spark, d)


@query("mdl12_model_grid")
def mdl12_model_grid(spark, d):
    """Test AUC of all 78 parameter sets for each household."""
    return search.grid_scores(activity_frame(spark, d), ["household_id"], "ts", ACTIVITY_COLUMNS, "activity")


# --- explanations --------------------------------------------------------------------

# Weights of a linear score used where attributions must be the same in SQL.
ACTIVITY_WEIGHTS = {
    "hour": 0.05, "activity_lag_24": 0.8, "activity_lag_48": 0.5, "activity_lag_72": 0.3,
    "day_name_Monday": -0.2, "day_name_Saturday": 0.4, "day_name_Sunday": 0.6,
    "day_name_Thursday": -0.1, "day_name_Tuesday": 0.1, "day_name_Wednesday": 0.2,
    "temp": -0.03, "dwpt": 0.02, "rhum": 0.01, "wdir": -0.001, "wspd": 0.1,
}
USAGE_WEIGHTS = {
    "usage_lag_1": 0.7, "usage_lag_2": 0.4, "active_last_2_days": 0.3,
    "temp": -0.03, "dwpt": 0.02, "rhum": 0.01, "wdir": -0.001, "wspd": 0.1,
}

_KNOWN_SQL = " AND ".join(f"{c} IS NOT NULL" for c in USAGE_WEIGHTS)
USAGE_FEATURES_SQL = (
    "(SELECT u.household_id, u.device, u.day, lag(usage, 1) OVER w1 AS usage_lag_1,"
    " lag(usage, 2) OVER w1 AS usage_lag_2,"
    " CAST(coalesce(lag(activity, 1) OVER w1, 0) = 1 OR coalesce(lag(activity, 2) OVER w1, 0) = 1 AS INT)"
    " AS active_last_2_days, "
    + ", ".join(_FILL.format(c=c, k="u.household_id, u.device", o="u.day") for c in WEATHER)
    + " FROM usage u LEFT JOIN weather_days w ON u.day = w.day"
    " WINDOW w1 AS (PARTITION BY u.household_id, u.device ORDER BY u.day)"
    " QUALIFY lag(usage, 2) OVER w1 IS NOT NULL)"
)


def _attribution_sql(source: str, ids: str, keys: str, weights: dict[str, float]) -> str:
    return " UNION ALL ".join(
        f"SELECT {ids}, '{c}' AS feature, CAST({c} AS DOUBLE) AS value,"
        f" CAST({w} AS DOUBLE) * ({c} - avg({c}) OVER (PARTITION BY {keys})) AS attribution FROM {source}"
        for c, w in weights.items()
    )


ACTIVITY_ATTR_SQL = _attribution_sql(
    ACTIVITY_FEATURES_SQL, "household_id, ts", "household_id", ACTIVITY_WEIGHTS
)
USAGE_ATTR_SQL = _attribution_sql(
    USAGE_FEATURES_SQL, "household_id, device, day", "household_id, device", USAGE_WEIGHTS
)


def activity_attributions(spark, d) -> DataFrame:
    rows = stage(activity_frame(spark, d, weather=True), "features")
    return explain.linear_attributions(
        rows, ["household_id", "ts"], ["household_id"], ACTIVITY_WEIGHTS
    )


def usage_attributions(spark, d) -> DataFrame:
    rows = stage(usage_frame(spark, d), "features")
    return explain.linear_attributions(
        rows, ["household_id", "device", "day"], ["household_id", "device"], USAGE_WEIGHTS
    )


def explained_models(spark, d) -> tuple[DataFrame, DataFrame]:
    """Written predictions of both agents with the reasons of each model, refitted every day, with the weather."""
    activity = per_entity.walk_forward(
        activity_frame(spark, d, weather=True), ["household_id"], "ts", [*ACTIVITY_COLUMNS, *WEATHER], "activity", explain=True
    )
    usage = per_entity.walk_forward(usage_frame(spark, d), USAGE_IDS[:2], "day", USAGE_COLUMNS, "usage", explain=True)
    return stage(activity, "activity-predictions"), stage(usage, "usage-predictions")


# The training data of a day has rows of both classes and all features.
_EXPLAINED_SQL = (
    "SELECT {ids}, true AS adds_up FROM (SELECT f.*, CAST(f.{at} AS DATE) AS d, l.{label} AS y FROM {source} f JOIN {truth} l USING ({ids})"
    " WHERE {known}) JOIN (SELECT {keys}, greatest(min(d) FILTER (WHERE y = 1), min(d) FILTER (WHERE y = 0)) AS both_known FROM"
    " (SELECT f.*, CAST(f.{at} AS DATE) AS d, l.{label} AS y FROM {source} f JOIN {truth} l USING ({ids}) WHERE {known})"
    " GROUP BY {keys} HAVING count(DISTINCT y) = 2) USING ({keys}) WHERE d > both_known"
)


def _gap(predictions: DataFrame, ids: list[str]) -> DataFrame:
    """Whether the attributions of each scored row add up to the log odds of its probability."""
    total = F.aggregate("phi", F.col("base"), lambda a, v: a + v)
    odds = F.log(F.col("p") / (1 - F.col("p")))
    known = predictions.where(F.col("p").isNotNull())
    return known.select(*ids, (F.abs(total - odds) < 1e-6 * (1 + F.abs(odds))).alias("adds_up"))


@query(
    "xai4_activity_model",
    _EXPLAINED_SQL.format(ids="household_id, ts", keys="household_id", at="ts", label="activity", truth="activity",
                          source=ACTIVITY_FEATURES_SQL, known=_WEATHER_KNOWN),
)
def xai4_activity_model(spark, d):
    """The reasons of the activity model of each day add up to its own log odds."""
    return _gap(explained_models(spark, d)[0], ["household_id", "ts"])


@query(
    "xai4_usage_model",
    _EXPLAINED_SQL.format(ids="household_id, device, day", keys="household_id, device", at="day", label="usage", truth="usage",
                          source=USAGE_FEATURES_SQL, known=_KNOWN_SQL),
)
def xai4_usage_model(spark, d):
    """The reasons of the usage model of each day add up to its own log odds."""
    return _gap(explained_models(spark, d)[1], USAGE_IDS)


def unscaled(attributions: DataFrame) -> DataFrame:
    return attributions.withColumn(
        "unscaled", F.when(F.col("feature").isin(*WEATHER), F.col("value"))
    )


@query(
    "xai4_linear",
    "SELECT household_id, ts, feature, round(value, 8) AS value, round(attribution, 8) AS attribution"
    f" FROM ({ACTIVITY_ATTR_SQL})",
)
def xai4_linear(spark, d):
    return rounded(activity_attributions(spark, d), 8)


@query(
    "xai5_importance_linear",
    "SELECT household_id, device, day, feature, round(attribution, 8) AS attribution,"
    " CAST(row_number() OVER (PARTITION BY household_id, device, day ORDER BY attribution DESC, feature) AS INT)"
    f" AS rank FROM ({USAGE_ATTR_SQL})",
)
def xai5_importance_linear(spark, d):
    ranked = explain.importance(usage_attributions(spark, d), ["household_id", "device", "day"])
    return rounded(ranked.drop("value"), 8)


@query(
    "xai9_mean_abs",
    "SELECT household_id, feature, round(avg(abs(attribution)), 8) AS importance"
    f" FROM ({ACTIVITY_ATTR_SQL}) GROUP BY household_id, feature",
)
def xai9_mean_abs(spark, d):
    return rounded(explain.mean_absolute(activity_attributions(spark, d), ["household_id"]), 8)


def _top_weather_sql(source: str, ids: str) -> str:
    labels = " ".join(
        f"WHEN '{f}' THEN '{label}'"
        for f, label in sorted(sentences.WEATHER_LABELS.items())
    )
    return (
        f"SELECT {ids}, string_agg(txt, ', ' ORDER BY attribution DESC, feature) AS txt, count(*) AS n FROM"
        f" (SELECT {ids}, feature, attribution, CASE feature {labels} END || ':' ||"
        f"  CAST(round(value, 2) AS VARCHAR) AS txt FROM ({source})"
        f"  WHERE feature IN ('dwpt', 'rhum', 'temp', 'wdir', 'wspd') AND attribution >= 0 AND value IS NOT NULL"
        f"  QUALIFY row_number() OVER (PARTITION BY {ids} ORDER BY attribution DESC, feature) <= 2)"
        f" GROUP BY ALL"
    )


_WEATHER_TEXT = (
    "CASE WHEN w.n = 2 THEN 'The weather conditions (' || w.txt || ') support that recommendation.'"
    " WHEN w.n = 1 THEN 'The weather condition (' || w.txt || ') support that recommendation.' ELSE '' END"
)


def _peak(source: str, ids: str, prefix: str, words: str) -> str:
    return (
        f"SELECT {ids}, CASE feature {words} END AS word FROM ({source})"
        f" WHERE feature LIKE '{prefix}%'"
        f" QUALIFY row_number() OVER (PARTITION BY {ids} ORDER BY attribution DESC, feature) = 1"
        " AND attribution >= 0"
    )


# The words and sentences below must equal the expected texts.
ACTIVITY_WORDS = (
    "WHEN 'activity_lag_24' THEN 'day' WHEN 'activity_lag_48' THEN 'two days' WHEN 'activity_lag_72' THEN 'three days'"
)
USAGE_WORDS = "WHEN 'usage_lag_1' THEN 'day' WHEN 'usage_lag_2' THEN 'two days'"
XAI6_SQL = (
    "SELECT a.household_id, a.ts, 'We based the recommendation on your past activity and usage of the device. '"
    " || CASE WHEN p.word IS NULL THEN '' ELSE 'We believe you are active today since you were ' ||"
    "  CASE WHEN a.was = 0 THEN 'not ' ELSE '' END || 'active during the last ' || p.word || '.' END || "
    + _WEATHER_TEXT +
    " || CASE WHEN a.wd >= 0 AND a.hr >= 0 THEN 'The weekday and hour strenghtens that prediction.'"
    "  WHEN a.wd >= 0 THEN 'The weekday strenghtens that prediction.'"
    "  WHEN a.hr >= 0 THEN 'The hour strenghtens that prediction.' ELSE '' END AS sentence FROM"
    " (SELECT household_id, ts, max(value) FILTER (WHERE feature LIKE 'activity_lag%') AS was,"
    "  max(attribution) FILTER (WHERE feature LIKE 'day_name%') AS wd,"
    f"  max(attribution) FILTER (WHERE feature = 'hour') AS hr FROM ({ACTIVITY_ATTR_SQL}) GROUP BY ALL) a"
    f" LEFT JOIN ({_peak(ACTIVITY_ATTR_SQL, 'household_id, ts', 'activity_lag', ACTIVITY_WORDS)}) p"
    " ON p.household_id = a.household_id AND p.ts = a.ts"
    f" LEFT JOIN ({_top_weather_sql(ACTIVITY_ATTR_SQL, 'household_id, ts')}) w"
    " ON w.household_id = a.household_id AND w.ts = a.ts"
)


@query("xai6_text", XAI6_SQL)
def xai6_text(spark, d):
    return sentences.activity_sentences(
        unscaled(activity_attributions(spark, d)), ["household_id", "ts"]
    )


XAI7_SQL = (
    "SELECT a.household_id, a.device, a.day, 'We believe you are likely to use the device in the near future"
    " since you were ' || CASE WHEN a.was = 0 THEN 'not ' ELSE '' END || 'active during the last 2 days' ||"
    " CASE WHEN p.word IS NULL THEN '' ELSE ' and have used the device in the last ' || p.word END || '.' || "
    + _WEATHER_TEXT + " AS sentence FROM"
    " (SELECT household_id, device, day, max(value) FILTER (WHERE feature = 'active_last_2_days') AS was"
    f"  FROM ({USAGE_ATTR_SQL}) GROUP BY ALL) a"
    f" LEFT JOIN ({_peak(USAGE_ATTR_SQL, 'household_id, device, day', 'usage_lag', USAGE_WORDS)}) p"
    " ON p.household_id = a.household_id AND p.device = a.device AND p.day = a.day"
    f" LEFT JOIN ({_top_weather_sql(USAGE_ATTR_SQL, 'household_id, device, day')}) w"
    " ON w.household_id = a.household_id AND w.device = a.device AND w.day = a.day"
)


@query("xai7_text", XAI7_SQL)
def xai7_text(spark, d):
    return sentences.usage_sentences(
        unscaled(usage_attributions(spark, d)), ["household_id", "device", "day"]
    )


def _usage_model(spark, d):
    rows = stage(usage_frame(spark, d).na.drop(subset=USAGE_COLUMNS), "features")
    train = rows.where(F.col("day") < "2024-01-22")
    test = rows.where(F.col("day") >= "2024-01-22")
    return train, test, pooled.fit("logit", train, USAGE_COLUMNS, "usage")


@query("xai2_shapley")
def xai2_shapley(spark, d):
    """Exact Shapley values of the usage model for every test day."""
    train, test, model = _usage_model(spark, d)
    background = explain.sample_background(train, USAGE_COLUMNS)
    return explain.shapley(test, USAGE_IDS, USAGE_COLUMNS, background, model.score, on_arrays=model.on_arrays())


_LINEAR_SQL = " + ".join(f"{w} * {c}" for c, w in USAGE_WEIGHTS.items())
_TRAIN_SQL = f"(SELECT * FROM {USAGE_FEATURES_SQL} WHERE {_KNOWN_SQL} AND day < DATE '2024-01-22')"
_TEST_SQL = f"(SELECT * FROM {USAGE_FEATURES_SQL} WHERE {_KNOWN_SQL} AND day >= DATE '2024-01-22')"


def linear_score(df: DataFrame) -> DataFrame:
    return df.withColumn("p", F.expr(_LINEAR_SQL))


def linear_on_arrays(x: np.ndarray) -> np.ndarray:
    return x @ np.array([USAGE_WEIGHTS[c] for c in USAGE_COLUMNS])


def _usage_rows(spark, d):
    rows = stage(usage_frame(spark, d).na.drop(subset=USAGE_COLUMNS), "features")
    return rows.where(F.col("day") < "2024-01-22"), rows.where(F.col("day") >= "2024-01-22")


@query(
    "xai2_shapley_linear",
    " UNION ALL ".join(
        f"SELECT t.household_id, t.device, t.day, '{c}' AS feature, round(CAST({w} AS DOUBLE) * (t.{c} - m.{c}), 7)"
        f" AS attribution FROM {_TEST_SQL} t CROSS JOIN (SELECT avg({c}) AS {c} FROM {_TRAIN_SQL}) m"
        for c, w in USAGE_WEIGHTS.items()
    ),
)
def xai2_shapley_linear(spark, d):
    """The Shapley job on a linear score has a closed form for any weighted background of the training mean.

    The background is one row per device with the device's number of rows as its weight.
    """
    train, test = _usage_rows(spark, d)
    groups = train.groupBy("device").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in USAGE_COLUMNS]).collect()
    n = sum(r.n for r in groups)
    background = [{"w": r.n / n, **{c: r[c] for c in USAGE_COLUMNS}} for r in groups]
    phi = explain.shapley(test, USAGE_IDS, USAGE_COLUMNS, background, linear_score)
    return rounded(phi.select(*USAGE_IDS, "feature", "attribution"), 7)


@query(
    "xai2_efficiency",
    f"SELECT household_id, device, day, CAST({len(USAGE_WEIGHTS)} AS BIGINT) AS features, true AS adds_up"
    f" FROM {_TEST_SQL}",
)
def xai2_efficiency(spark, d):
    """Attributions add up to the model's own score of the row less its mean score of the background."""
    train, test, model = _usage_model(spark, d)
    background = explain.sample_background(train, USAGE_COLUMNS)
    phi = explain.shapley(test, USAGE_IDS, USAGE_COLUMNS, background, model.score, on_arrays=model.on_arrays())
    mean = model.score(spark.createDataFrame(background)).agg(F.sum(F.col("w") * F.col("p"))).first()[0]
    total = phi.groupBy(*USAGE_IDS).agg(F.count(F.lit(1)).alias("features"), F.sum("attribution").alias("sum"))
    own = model.score(test).select(*USAGE_IDS, "p")
    gap = F.abs(F.col("sum") - (F.col("p") - F.lit(mean)))
    return total.join(own, USAGE_IDS).select(*USAGE_IDS, "features", (gap < 1e-9).alias("adds_up"))


@query(
    "xai1_lime_linear",
    " UNION ALL ".join(
        f"SELECT household_id, device, day, '{c}' AS feature, CAST({w} AS DOUBLE) AS weight,"
        f" round({_LINEAR_SQL}, 5) AS local_pred FROM {_TEST_SQL}"
        for c, w in USAGE_WEIGHTS.items()
    ),
)
def xai1_lime_linear(spark, d):
    """A local surrogate of a linear score finds its weights."""
    train, test = _usage_rows(spark, d)
    scales = explain.feature_scales(train, USAGE_COLUMNS)
    out = explain.lime(
        test, USAGE_IDS, USAGE_COLUMNS, scales, linear_score, alpha=1e-10, on_arrays=linear_on_arrays
    )
    return rounded(out.select(*USAGE_IDS, "feature", "weight", "local_pred"), 5)


@query(
    "xai2_shapley_kernel_linear",
    " UNION ALL ".join(
        f"SELECT t.household_id, t.device, t.day, '{c}' AS feature, round(CAST({w} AS DOUBLE) * (t.{c} - m.{c}), 7)"
        f" AS attribution FROM {_TEST_SQL} t CROSS JOIN (SELECT avg({c}) AS {c} FROM {_TRAIN_SQL}) m"
        for c, w in USAGE_WEIGHTS.items()
    ),
)
def xai2_shapley_kernel_linear(spark, d):
    """The regression on drawn coalitions finds the closed form of a linear score, whichever coalitions are drawn."""
    train, test = _usage_rows(spark, d)
    groups = train.groupBy("device").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in USAGE_COLUMNS]).collect()
    n = sum(r.n for r in groups)
    background = [{"w": r.n / n, **{c: r[c] for c in USAGE_COLUMNS}} for r in groups]
    phi = explain.shapley(test, USAGE_IDS, USAGE_COLUMNS, background, linear_score, "kernel", permutations=24)
    return rounded(phi.select(*USAGE_IDS, "feature", "attribution"), 7)


@query("xai2_shapley_activity")
def xai2_shapley_activity(spark, d):
    """Shapley values of the 15 columns of the pooled activity model at the evening peak of every scored day, to a stated standard error."""
    columns = [*ACTIVITY_COLUMNS, *WEATHER]
    train, test = (df.na.drop(subset=columns) for df in train_test(spark, d, weather=True))
    model = pooled.fit("logit", train, columns, "activity")
    background = explain.sample_background(train, columns, 20)
    return explain.shapley_within(
        test.where("hour = 18"), ["household_id", "ts"], columns, background, model.score, error=0.005
    )


@query("xai5_importance")
def xai5_importance(spark, d):
    train, test, model = _usage_model(spark, d)
    background = explain.sample_background(train, USAGE_COLUMNS)
    phi = explain.shapley(test, USAGE_IDS, USAGE_COLUMNS, background, model.score, on_arrays=model.on_arrays())
    return explain.importance(phi, USAGE_IDS)


@query("xai10_kmeans_background")
def xai10_kmeans_background(spark, d):
    train, test, model = _usage_model(spark, d)
    background = explain.kmeans_background(train, USAGE_COLUMNS, 10)
    return explain.shapley(test, USAGE_IDS, USAGE_COLUMNS, background, model.score, on_arrays=model.on_arrays())


@query("xai1_lime")
def xai1_lime(spark, d):
    train, test, model = _usage_model(spark, d)
    return explain.lime(
        test, USAGE_IDS, USAGE_COLUMNS, explain.feature_scales(train, USAGE_COLUMNS),
        model.score, on_arrays=model.on_arrays(),
    )


@query("xai8_surrogate_scores")
def xai8_surrogate_scores(spark, d):
    """Scores of the local surrogates' predictions against the truth and against the usage model itself, per household."""
    train, test, model = _usage_model(spark, d)
    scales = explain.feature_scales(train, USAGE_COLUMNS)
    surrogates = explain.lime(test, USAGE_IDS, USAGE_COLUMNS, scales, model.score, on_arrays=model.on_arrays())
    surrogates = stage(surrogates, "surrogates")
    # one row for each explained day and device
    local = surrogates.where(F.col("feature") == USAGE_COLUMNS[0]).select(*USAGE_IDS, F.col("local_pred").alias("surrogate"))
    own = model.score(test).select(*USAGE_IDS, F.col("usage").alias("label"), F.col("p").alias("model"))
    rows = stage(own.join(local, USAGE_IDS), "surrogate-rows")
    return metrics.explanation_scores(rows, ["household_id"], "label", "model", "surrogate")


@query("xai12_lime_weights")
def xai12_lime_weights(spark, d):
    return explain.ranked_weights(xai1_lime(spark, d), USAGE_IDS)


def usage_folds(spark, d, model_type: str, **params):
    """Rows of every week, the model that was fitted on all weeks before it, and a background of its training rows."""
    rows = stage(usage_frame(spark, d).na.drop(subset=[*USAGE_COLUMNS, "usage"]), "features")
    for first, last in pooled.folds(rows, "day", "week"):
        train = rows.where(F.col("day") < first)
        if train.select("usage").distinct().limit(2).count() == 2:
            fitted = pooled.fit(model_type, train, USAGE_COLUMNS, "usage", **params)
            background = explain.sample_background(train, USAGE_COLUMNS)
            yield rows.where(F.col("day").between(first, last)), fitted, background


def tree_explanations(spark, d, model_type: str) -> DataFrame:
    """Shapley values of the probability for every device and day after the first week."""
    parts = [
        attributions.tree_shapley(rows, USAGE_IDS, fitted, background)
        for rows, fitted, background in usage_folds(spark, d, model_type)
    ]
    return reduce(DataFrame.unionByName, parts)


@query("xai3_tree_forest")
def xai3_tree_forest(spark, d):
    """Shapley values of the pooled usage forest, by the paths of its leaves."""
    return tree_explanations(spark, d, "random forest")


@query("xai3_tree_boosting")
def xai3_tree_boosting(spark, d):
    """Shapley values of the pooled boosted usage model, by the paths of its leaves."""
    return tree_explanations(spark, d, "xgboost")


# The first week starts on the Monday of the first day, and the model of a week needs days before it.
_ADDS_UP_SQL = (
    f"SELECT household_id, device, day, CAST({len(USAGE_WEIGHTS)} AS BIGINT) AS features, true AS adds_up"
    f" FROM (SELECT * FROM {USAGE_FEATURES_SQL} WHERE {_KNOWN_SQL}) r"
    " WHERE day >= date_trunc('week', (SELECT min(day) FROM (SELECT * FROM "
    f"{USAGE_FEATURES_SQL} WHERE {_KNOWN_SQL}))) + INTERVAL 7 DAY"
)


def adds_up(spark, d, model_type: str, method: str, output: str) -> DataFrame:
    """Whether attributions add up to the model's own score less the mean score of the background."""
    parts = []
    for rows, fitted, background in usage_folds(spark, d, model_type):
        phi = attributions.tree_shapley(rows, USAGE_IDS, fitted, background, method, output)
        total = phi.groupBy(*USAGE_IDS).agg(
            F.count(F.lit(1)).alias("features"), F.sum("attribution").alias("sum"), F.first("base").alias("base")
        )
        own = fitted.score(rows).select(*USAGE_IDS, "p")
        if output == "margin":
            own = own.withColumn("p", F.log(F.col("p") / (1 - F.col("p"))))
        parts.append(total.join(own, USAGE_IDS).select(
            *USAGE_IDS, "features", (F.abs(F.col("sum") - (F.col("p") - F.col("base"))) < 1e-8).alias("adds_up")
        ))
    return reduce(DataFrame.unionByName, parts)


@query("xai3_forest_adds_up", _ADDS_UP_SQL)
def xai3_forest_adds_up(spark, d):
    """Shapley values of the forest's probability add up."""
    return adds_up(spark, d, "random forest", "background", "probability")


@query("xai3_boosting_adds_up", _ADDS_UP_SQL)
def xai3_boosting_adds_up(spark, d):
    """Shapley values of the boosted margin, by shares of covers, add up."""
    return adds_up(spark, d, "xgboost", "cover", "margin")


@query("xai_met7_seconds_per_day")
def xai_met7_seconds_per_day(spark, d):
    """Task seconds per explained day of the boosted usage model."""
    return timing.seconds_per_day(spark, "usage", "tree paths", lambda: xai3_tree_boosting(spark, d))


@query("xai11_additive")
def xai11_additive(spark, d):
    train, test = train_test(spark, d, weather=True)
    columns = ACTIVITY_COLUMNS + WEATHER
    model = pooled.fit("ebm", train.na.drop(subset=columns), columns, "activity")
    return model.contributions(test, ["household_id", "ts"])


@query("xai11_shapes")
def xai11_shapes(spark, d):
    train, _ = train_test(spark, d, weather=True)
    columns = ACTIVITY_COLUMNS + WEATHER
    model = pooled.fit("ebm", train.na.drop(subset=columns), columns, "activity")
    return pooled.shape_table(model)


_OPTIMUM_SQL = " UNION ALL ".join(f"SELECT '{c}' AS feature, true AS is_zero" for c in ["intercept", *USAGE_WEIGHTS])


@query("mdl1_optimum", _OPTIMUM_SQL)
def mdl1_optimum(spark, d):
    """The gradient of the penalised loss, summed up from the rows, vanishes at the fitted weights."""
    train, _, model = _usage_model(spark, d)
    fitted = model.model.stages[-1]
    weights = dict(zip(USAGE_COLUMNS, map(float, fitted.coefficients)))
    linear = sum((F.lit(w) * F.col(c) for c, w in weights.items()), F.lit(float(fitted.intercept)))
    residual = 1 / (1 + F.exp(-linear)) - F.col("usage")
    # the loss is a mean, so the penalty weighs 1 / rows
    slopes = {"intercept": F.avg(residual)}
    slopes |= {c: F.avg(residual * F.col(c)) + F.lit(w) / F.count(F.lit(1)) for c, w in weights.items()}
    scales = {"intercept": F.lit(1.0), **{c: F.greatest(F.lit(1.0), F.avg(F.abs(F.col(c)))) for c in weights}}
    parts = [
        F.struct(F.lit(c).alias("feature"), (F.abs(g) / scales[c] < 1e-3).alias("is_zero")) for c, g in slopes.items()
    ]
    return train.agg(F.array(*parts).alias("parts")).select(F.inline("parts"))


@query(
    "xai11_adds_up",
    "SELECT household_id, ts, true AS adds_up FROM"
    f" (SELECT * FROM {ACTIVITY_FEATURES_SQL} WHERE ts >= DATE '2024-01-22' AND "
    + " AND ".join(f"{c} IS NOT NULL" for c in WEATHER) + ")",
)
def xai11_adds_up(spark, d):
    """The additive model's probability follows from its intercept and the contributions of a row."""
    train, test = train_test(spark, d, weather=True)
    columns = ACTIVITY_COLUMNS + WEATHER
    model = pooled.fit("ebm", train.na.drop(subset=columns), columns, "activity")
    known = test.na.drop(subset=columns)
    ids = ["household_id", "ts"]
    total = model.contributions(known, ids).groupBy(*ids).agg(F.sum("contribution").alias("sum"))
    own = model.score(known).select(*ids, "p")
    odds = F.col("sum") + F.lit(model.shapes.intercept)
    gap = F.abs(1 / (1 + F.exp(-odds)) - F.col("p"))
    return own.join(total, ids).select(*ids, (gap < 1e-9).alias("adds_up"))
