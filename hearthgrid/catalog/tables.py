"""Queries on files and sinks, projections, set operations and lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from hearthgrid.catalog import views as V
from hearthgrid.catalog.decisions import KEY, MSE_SQL, PAIR, TOLERANCES, Prepared, _auc_sql
from hearthgrid.catalog.modelling import ACTIVITY_ATTR_SQL, USAGE_ATTR_SQL, USAGE_FEATURES_SQL
from hearthgrid.catalog.modelling import USAGE_COLUMNS, WEATHER, XAI6_SQL, XAI7_SQL
from hearthgrid.catalog.modelling import ACTIVITY_COLUMNS, KNN_SQL, activity_attributions, cold_starts, daily, daily_usage
from hearthgrid.catalog.modelling import explained_models, unscaled, usage_attributions, usage_frame
from hearthgrid.catalog.preparation import METER, hourly, load
from hearthgrid.catalog.registry import NUDGE, query, rounded
from hearthgrid.functions.exprs import agent_key
from hearthgrid.functions.times import hour_start
from hearthgrid.models import per_entity
from hearthgrid.operators import metrics, resample
from hearthgrid.operators.prefix import weighted_quantiles
from hearthgrid.operators.runs import DEVICE, HOURS
from hearthgrid.plans import decide, explained, prepare
from hearthgrid.plans.dates import before_date
from hearthgrid.session import stage, staging_dir
from hearthgrid.sources import meter, tables

# Slot of each appliance in the meter files written by the queries below.
SLOT_OF = {"Washing Machine": 1, "Tumble Dryer": 2, "Dishwasher": 3, "Kettle": 4, "Television": 5}


def _new_path(spark, name: str) -> str:
    return f"{staging_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    "src1_meter_csv",
    "SELECT household_id, ts, 'Appliance' || CASE appliance "
    + " ".join(f"WHEN '{a}' THEN '{i}'" for a, i in SLOT_OF.items())
    + " END AS slot, round(watts, 3) AS watts FROM hourly UNION ALL"
    " SELECT household_id, ts, 'Aggregate', round(sum(round(watts, 3)), 3) FROM hourly GROUP BY household_id, ts",
)
def src1_meter_csv(spark, d):
    """Meter files written per house from the hourly readings, read back and melted."""
    slots = {f"Appliance{i}": a for a, i in SLOT_OF.items()}
    rows = hourly(spark, d).withColumn("watts", F.round("watts", 3))
    wide = meter.to_wide(rows, ["household_id", "ts"], list(SLOT_OF), "appliance")
    files = wide.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Time"),
        F.lit(0).cast("bigint").alias("Unix"),
        F.round(sum((F.col(f"`{a}`") for a in SLOT_OF), F.lit(0.0)), 3).alias("Aggregate"),
        *[
            (F.col(f"`{slots[s]}`") if s in slots else F.lit(None).cast("double")).alias(s)
            for s in meter.SLOTS[1:]
        ],
        F.concat(F.lit("CLEAN_House"), F.col("household_id"), F.lit(".csv")).alias("file"),
    )
    path = _new_path(spark, "meter")
    files.write.partitionBy("file").option("header", True).csv(path)
    read = meter.read_meter_csv(spark, f"{path}/*/*.csv")
    return meter.melt(read, ["household_id", "ts"], meter.SLOTS)


@query(
    "snk1_partitioned_table",
    "SELECT household_id, device, ts, round(load, 6) AS load FROM device_load",
)
def snk1_partitioned_table(spark, d):
    path = _new_path(spark, "load")
    tables.write_table(load(spark, d), path, "household_id")
    return rounded(tables.read_table(spark, path))


@query(
    "snk2_weather_tables",
    "SELECT 'hour' AS grain, ts, "
    + ", ".join(f"round({c}, 8) AS {c}" for c in WEATHER)
    + " FROM weather UNION ALL SELECT 'day', CAST(day AS TIMESTAMP), "
    + ", ".join(f"round({c}, 8)" for c in WEATHER) + " FROM weather_days",
)
def snk2_weather_tables(spark, d):
    path = _new_path(spark, "weather")
    tables.write_unscaled_weather(V.weather(spark, d), path)
    read = lambda grain: tables.read_table(spark, f"{path}/{grain}").select(
        F.lit(grain).alias("grain"), "ts", *WEATHER
    )
    return rounded(read("hour").unionByName(read("day")), 8)


@query(
    "snk2_house_means",
    "SELECT 'hour' AS grain, household_id, appliance, ts, round(watts, 6) AS watts FROM hourly UNION ALL"
    f" SELECT 'day', household_id, appliance, date_trunc('day', ts), round(avg(watts) + {NUDGE}, 6) FROM hourly GROUP BY ALL",
)
def snk2_house_means(spark, d):
    """Unscaled means of every appliance by hour and day, written and read again."""
    path = _new_path(spark, "house")
    tables.write_house_means(hourly(spark, d), path)
    read = lambda grain, nudge: rounded(
        tables.read_unscaled(spark, path, grain).select(F.lit(grain).alias("grain"), *METER, "ts", "watts"), nudge=nudge
    )
    return read("hour", 0.0).unionByName(read("day", NUDGE))


@query(
    "snk3_append_scores",
    f"SELECT 'length' AS model, 'all' AS params, 'auc' AS metric, auc AS value FROM ({_auc_sql('scores', '', 'label', 'score')})"
    " UNION ALL SELECT 'frequency', CAST(household_id AS VARCHAR), 'auc', auc FROM"
    f" ({_auc_sql('surrogates', 'household_id', 'label', 'model')})",
)
def snk3_append_scores(spark, d):
    """AUC rows of two models appended to one table one after the other."""
    path = _new_path(spark, "scores")
    rows = lambda scores, model, params: scores.select(
        F.lit(model).alias("model"), F.create_map(F.lit("rows"), params).alias("params"),
        F.lit("auc").alias("metric"), F.col("auc").alias("value"),
    )
    one = metrics.auc(V.scores(spark, d), [], "label", "score")
    tables.append_scores(rows(one, "length", F.lit("all")), path)
    many = metrics.auc(Prepared(spark, d).surrogates(), ["household_id"], "label", "model")
    tables.append_scores(rows(many, "frequency", F.col("household_id").cast("string")), path)
    read = tables.read_table(spark, path)
    return rounded(read.select("model", F.col("params")["rows"].alias("params"), "metric", "value"))


@query(
    "flt5_usage_projection",
    "SELECT household_id, device, day, usage_lag_1, usage_lag_2, active_last_2_days, "
    + ", ".join(f"round({c}, 8) AS {c}" for c in WEATHER) + f" FROM {USAGE_FEATURES_SQL}",
)
def flt5_usage_projection(spark, d):
    frame = prepare.usage_features(hourly(spark, d), V.CONFIG, V.weather(spark, d))
    known = frame.na.drop(subset=["usage_lag_1", "usage_lag_2"])
    return rounded(known.select(*KEY, *USAGE_COLUMNS), 8)


_SETTINGS_SQL = (
    "(SELECT household_id, 0.3 + 0.1 * (household_id % 3) AS thr, CASE WHEN household_id % 2 = 0"
    " THEN ['Kettle', 'Dishwasher'] ELSE ['Television', 'Kettle', 'Tumble Dryer'] END AS act,"
    " CASE WHEN household_id % 2 = 0 THEN ['Dishwasher'] ELSE ['Washing Machine', 'Tumble Dryer'] END AS dev"
    " FROM (SELECT DISTINCT household_id FROM readings))"
)


def household_settings(spark, d):
    """Configuration documents with other devices and thresholds for odd and even households."""
    house = V.readings(spark, d).select("household_id").distinct()
    even = F.col("household_id") % 2 == 0
    names = lambda *xs: F.array(*[F.lit(x) for x in xs])
    return house.select(
        F.struct(F.col("household_id").alias("household")).alias("data"),
        F.struct(
            F.when(even, names("Dishwasher")).otherwise(names("Washing Machine", "Tumble Dryer"))
            .alias("shiftable_devices"),
            F.when(even, names("Kettle", "Dishwasher"))
            .otherwise(names("Television", "Kettle", "Tumble Dryer")).alias("active_appliances"),
            (0.3 + 0.1 * (F.col("household_id") % 3)).alias("threshold"),
        ).alias("user_input"),
    )


@query(
    "src7_household_settings",
    "SELECT h.household_id, CAST(h.ts AS DATE) AS day, h.appliance AS device,"
    " CAST(max(CASE WHEN h.scaled > s.thr THEN 1 ELSE 0 END) AS INT) AS usage,"
    " CAST(any_value(a.activity) AS INT) AS activity"
    f" FROM hourly h JOIN {_SETTINGS_SQL} s ON h.household_id = s.household_id"
    " JOIN (SELECT h.household_id, CAST(h.ts AS DATE) AS day,"
    "   max(CASE WHEN h.scaled > s.thr AND list_contains(s.act, h.appliance) THEN 1 ELSE 0 END) AS activity"
    f"   FROM hourly h JOIN {_SETTINGS_SQL} s ON h.household_id = s.household_id GROUP BY ALL) a"
    "  ON a.household_id = h.household_id AND a.day = CAST(h.ts AS DATE)"
    " WHERE list_contains(s.dev, h.appliance) GROUP BY h.household_id, CAST(h.ts AS DATE), h.appliance",
)
def src7_household_settings(spark, d):
    settled = prepare.with_household_settings(hourly(spark, d), household_settings(spark, d))
    return prepare.household_usage(settled)


@query(
    "evl11_all_households",
    "SELECT h.household_id, h.appliance AS device, count(*) FILTER (WHERE h.scaled > s.thr) AS hours_on,"
    " round(sum(CASE WHEN h.scaled > s.thr THEN h.watts ELSE 0 END), 4) AS load,"
    " CAST(any_value(a.n) AS BIGINT) AS active_hours"
    f" FROM hourly h JOIN {_SETTINGS_SQL} s ON h.household_id = s.household_id"
    " JOIN (SELECT household_id, sum(activity) AS n FROM (SELECT h.household_id, h.ts,"
    "   max(CASE WHEN h.scaled > s.thr AND list_contains(s.act, h.appliance) THEN 1 ELSE 0 END) AS activity"
    f"   FROM hourly h JOIN {_SETTINGS_SQL} s ON h.household_id = s.household_id GROUP BY ALL) GROUP BY ALL) a"
    "  ON a.household_id = h.household_id"
    " WHERE list_contains(s.dev, h.appliance) GROUP BY h.household_id, h.appliance",
)
def evl11_all_households(spark, d):
    """Each household with its own devices and threshold, all in one job."""
    settled = stage(
        prepare.with_household_settings(hourly(spark, d), household_settings(spark, d)), "settled"
    )
    active = prepare.household_activity(settled).groupBy("household_id").agg(
        F.sum("activity").alias("active_hours")
    )
    loads = prepare.household_load(settled, "zero").groupBy(*DEVICE).agg(
        F.count_if(F.col("load") > 0).alias("hours_on"), F.sum("load").alias("load")
    )
    return rounded(loads.join(active, "household_id"), 4)


@query("flt3_numeric_columns", "SELECT household_id, watts FROM readings")
def flt3_numeric_columns(spark, d):
    rows = V.readings(spark, d)
    numeric = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("integer", "double")]
    return rows.select(*numeric)


@query(
    "flt11_until_yesterday",
    "SELECT household_id, appliance, ts, watts FROM readings WHERE CAST(ts AS DATE) < DATE '2024-01-15'",
)
def flt11_until_yesterday(spark, d):
    return before_date(V.readings(spark, d), "2024-01-15")


@query(
    "res3_hour_floor",
    "SELECT household_id, appliance, ts, date_trunc('hour', ts) AS hour_ts FROM readings",
)
def res3_hour_floor(spark, d):
    return V.readings(spark, d).select(*METER, "ts", hour_start(F.col("ts")).alias("hour_ts"))


@query(
    "res4_date_range",
    "SELECT household_id, unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE),"
    " INTERVAL 1 DAY))::TIMESTAMP AS ts FROM readings GROUP BY household_id",
)
def res4_date_range(spark, d):
    days = V.readings(spark, d).select("household_id", F.to_date("ts").cast("timestamp_ntz").alias("ts"))
    return resample.span_grid(days, ["household_id"], ["household_id"], "day", "ts")


@query(
    "set1_union_years",
    "SELECT year(ts) AS year, count(*) AS n, round(avg(price), 8) AS price FROM"
    " (SELECT ts, price FROM prices UNION ALL SELECT ts - INTERVAL 1 YEAR, price FROM prices) GROUP BY ALL",
)
def set1_union_years(spark, d):
    prices = V.prices(spark, d)
    both = prices.unionByName(prices.withColumn("ts", F.col("ts") - F.expr("interval 1 year")))
    return rounded(
        both.groupBy(F.year("ts").cast("bigint").alias("year")).agg(
            F.count(F.lit(1)).alias("n"), F.avg("price").alias("price")
        ), 8,
    )


@query(
    "set2_other_appliances",
    "SELECT DISTINCT household_id, appliance FROM readings EXCEPT"
    " SELECT household_id, device FROM device_load",
)
def set2_other_appliances(spark, d):
    t = Prepared(spark, d)
    devices = t.load().select("household_id", F.col("device").alias("appliance"))
    return t.hourly.select(*METER).distinct().subtract(devices.distinct())


@query(
    "agg2_price_quantiles",
    "SELECT CAST(hour(ts) AS INT) AS hour, count(*) AS n, round(quantile_cont(price, 0.25) + 3e-8, 6) AS q1,"
    " round(quantile_cont(price, 0.5) + 3e-8, 6) AS median, round(quantile_cont(price, 0.75) + 3e-8, 6) AS q3"
    " FROM prices GROUP BY hour(ts)",
)
def agg2_price_quantiles(spark, d):
    counts = V.prices(spark, d).groupBy(F.hour("ts").alias("hour"), "price").agg(
        F.count(F.lit(1)).alias("n")
    )
    out = weighted_quantiles(counts, ["hour"], "price", "n", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return rounded(out, nudge=NUDGE)


@query(
    "lod2_true_loads",
    "SELECT household_id, device, start_ts, "
    + ", ".join(
        f"round(coalesce(max(load) FILTER (WHERE off = {i}), 0) + {NUDGE}, 6) AS h{i + 1}" for i in range(24)
    )
    + " FROM run_hours GROUP BY household_id, device, start_ts",
)
def lod2_true_loads(spark, d):
    table = Prepared(spark, d).runs()
    wide = table.selectExpr(*DEVICE, "start_ts", *[f"load[{i}] AS {h}" for i, h in enumerate(HOURS)])
    return rounded(wide, nudge=NUDGE)


@query(
    "top1_cheapest_hour",
    "SELECT household_id, device, day, min_by(start_hour, {'c': cost, 'h': start_hour}) AS hour,"
    " round(min(cost), 4) AS cost FROM costs GROUP BY household_id, device, day",
)
def top1_cheapest_hour(spark, d):
    """Cheapest start of the typical run without any probability."""
    inputs = Prepared(spark, d).inputs().where(F.col("prices").isNotNull())
    best = decide.start_costs("prices", "profile")
    costed = inputs.select(*KEY, best.alias("costs")).withColumn(
        "best", F.expr("array_min(transform(costs, (c, h) -> named_struct('c', c, 'h', h)))")
    )
    return rounded(costed.select(*KEY, F.col("best.h").alias("hour"), F.col("best.c").alias("cost")), 4)


@query(
    "top2_weather_attributions",
    "SELECT household_id, device, day, feature, round(attribution, 8) AS attribution FROM"
    f" ({USAGE_ATTR_SQL}) WHERE feature IN ('dwpt', 'rhum', 'temp', 'wdir', 'wspd') AND attribution IS NOT NULL"
    " QUALIFY row_number() OVER (PARTITION BY household_id, device, day ORDER BY attribution DESC, feature) <= 2",
)
def top2_weather_attributions(spark, d):
    rows = usage_attributions(spark, d).where(
        F.col("feature").isin(*WEATHER) & F.col("attribution").isNotNull()
    )
    w = Window.partitionBy(*KEY).orderBy(F.desc("attribution"), "feature")
    top = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 2)
    return rounded(top.select(*KEY, "feature", "attribution"), 8)


@query(
    "jn4_truth_lookup",
    "SELECT r.household_id, r.device, r.day, u.usage AS usage_true, a.activity AS activity_true"
    f" FROM (SELECT * FROM recs WHERE {PAIR}) r"
    " LEFT JOIN usage u ON u.household_id = r.household_id AND u.device = r.device AND u.day = r.day"
    " LEFT JOIN activity a ON a.household_id = r.household_id"
    "  AND a.ts = CAST(r.day AS TIMESTAMP) + to_hours(r.recommendation)",
)
def jn4_truth_lookup(spark, d):
    out = decide.recommend(Prepared(spark, d).costed_with_truth(), 0.25, 0.375)
    return out.select(
        *KEY, "usage_true", F.expr("get(activity_true, recommendation)").alias("activity_true")
    )


@query(
    "jn7_run_load",
    "SELECT r.household_id, r.device, r.day, round(coalesce(sum(h.load), 0), 6) AS run_watts"
    f" FROM (SELECT * FROM relevant WHERE {PAIR}) r LEFT JOIN run_hours h"
    " ON h.household_id = r.household_id AND h.device = r.device"
    " AND h.start_ts = CAST(r.day AS TIMESTAMP) + to_hours(r.relevant_start)"
    " GROUP BY r.household_id, r.device, r.day",
)
def jn7_run_load(spark, d):
    out = decide.recommend(Prepared(spark, d).costed_with_truth(), 0.25, 0.375)
    run = decide.nearest_start("starts", "recommendation")
    total = F.expr("coalesce(aggregate(_run.load, 0D, (t, x) -> t + x), 0D)")
    return rounded(out.withColumn("_run", run).select(*KEY, total.alias("run_watts")))


@query(
    "jn9_aligned_predictions",
    "SELECT household_id, ts, label, round(model, 8) AS model, round(surrogate, 8) AS surrogate FROM surrogates",
)
def jn9_aligned_predictions(spark, d):
    return rounded(Prepared(spark, d).surrogates(), 8)


_USAGE_SCORES = (
    "(SELECT u.household_id, u.device, u.usage, p.p FROM usage u JOIN p_usage p ON p.household_id = u.household_id"
    " AND p.device = u.device AND p.day = u.day WHERE p.p IS NOT NULL)"
)


@query(
    "evl10_agent_scores",
    "SELECT household_id, 'load_' || lower(replace(device, ' ', '_')) AS agent, 'mse' AS metric, mse AS value"
    f" FROM ({MSE_SQL}) UNION ALL"
    f" SELECT household_id, 'activity', 'auc', auc FROM ({_auc_sql('surrogates', 'household_id', 'label', 'model')})"
    " UNION ALL SELECT household_id, 'usage_' || lower(replace(device, ' ', '_')), 'auc', auc FROM"
    f" ({_auc_sql(_USAGE_SCORES, 'household_id, device', 'usage', 'p')})",
)
def evl10_agent_scores(spark, d):
    """AUC of activity and usage and error of the load profiles, of all agents in one long table."""
    t = Prepared(spark, d)
    agent = lambda kind: F.concat(F.lit(f"{kind}_"), agent_key(F.col("device"))).alias("agent")
    load_rows = metrics.load_mse(t.runs(), t.profiles()).select(
        "household_id", agent("load"), F.lit("mse").alias("metric"), F.round("mse", 4).alias("value")
    )
    activity_rows = metrics.auc(t.surrogates(), ["household_id"], "label", "model").select(
        "household_id", F.lit("activity").alias("agent"), F.lit("auc").alias("metric"), F.col("auc").alias("value")
    )
    p = decide.usage_frequency(t.usage())
    scored = t.usage().select(*KEY, "usage").join(p, KEY).where(F.col("p").isNotNull())
    usage_rows = metrics.auc(scored, DEVICE, "usage", "p").select(
        "household_id", agent("usage"), F.lit("auc").alias("metric"), F.col("auc").alias("value")
    )
    return rounded(load_rows.unionByName(activity_rows).unionByName(usage_rows))


def agent_scores(t: Prepared, activity, usage):
    """Scores of all agents in long form, from predictions with ``label`` and ``p``."""
    agent = lambda kind: F.concat(F.lit(f"{kind}_"), agent_key(F.col("device"))).alias("agent")
    load_rows = metrics.load_mse(t.runs(), t.profiles()).select(
        "household_id", agent("load"), F.lit("mse").alias("metric"), F.round("mse", 4).alias("value")
    )
    activity_rows = metrics.auc(activity, ["household_id"], "label", "p").select(
        "household_id", F.lit("activity").alias("agent"), F.lit("auc").alias("metric"), F.col("auc").alias("value")
    )
    usage_rows = metrics.auc(usage, DEVICE, "label", "p").select(
        "household_id", agent("usage"), F.lit("auc").alias("metric"), F.col("auc").alias("value")
    )
    return rounded(load_rows.unionByName(activity_rows).unionByName(usage_rows))


@query("mdl10_agent_scores")
def mdl10_agent_scores(spark, d):
    """Scores of the agents' own models, refitted every day."""
    return agent_scores(
        Prepared(spark, d), stage(daily(spark, d, "logit"), "activity"), stage(daily_usage(spark, d), "usage")
    )


_KNN_SCORED = f"(SELECT p.household_id, a.activity AS label, p.p FROM ({KNN_SQL}) p JOIN activity a USING (household_id, ts))"
# Days since the last use and flags of the last two days: neighbours of a day among the days before it, the earlier of equals first.
_USAGE_ROWS = f"(SELECT f.*, u.usage FROM {USAGE_FEATURES_SQL} f JOIN usage u USING (household_id, device, day))"
_USAGE_KNN = (
    "(SELECT household_id, device, day, any_value(own) AS label, avg(usage) AS p FROM"
    " (SELECT a.household_id, a.device, a.day, a.usage AS own, b.usage FROM"
    f" {_USAGE_ROWS} a JOIN {_USAGE_ROWS} b ON a.household_id = b.household_id AND a.device = b.device AND b.day < a.day"
    "  QUALIFY row_number() OVER (PARTITION BY a.household_id, a.device, a.day ORDER BY abs(a.usage_lag_1 - b.usage_lag_1)"
    "   + abs(a.usage_lag_2 - b.usage_lag_2) + abs(a.active_last_2_days - b.active_last_2_days), b.day) <= 10"
    "   AND min(b.usage) OVER (PARTITION BY a.household_id, a.device, a.day)"
    "    < max(b.usage) OVER (PARTITION BY a.household_id, a.device, a.day)) GROUP BY ALL)"
)


@query(
    "evl10_agent_scores_neighbours",
    "SELECT household_id, 'load_' || lower(replace(device, ' ', '_')) AS agent, 'mse' AS metric, mse AS value"
    f" FROM ({MSE_SQL}) UNION ALL"
    f" SELECT household_id, 'activity', 'auc', auc FROM ({_auc_sql(_KNN_SCORED, 'household_id', 'label', 'round(p, 6)')})"
    " UNION ALL SELECT household_id, 'usage_' || lower(replace(device, ' ', '_')), 'auc', auc FROM"
    f" ({_auc_sql(_USAGE_KNN, 'household_id, device', 'label', 'round(p, 6)')})",
)
def evl10_agent_scores_neighbours(spark, d):
    """Scores of nearest-neighbour agents of each household, from predictions of every day."""
    known = lambda df: df.where(F.col("p").isNotNull()).withColumn("p", F.round("p", 6))
    flags = ["usage_lag_1", "usage_lag_2", "active_last_2_days"]
    usage = per_entity.walk_forward(usage_frame(spark, d), DEVICE, "day", flags, "usage", "knn", n_neighbors=10)
    return agent_scores(
        Prepared(spark, d), stage(known(daily(spark, d, "knn", n_neighbors=10)), "activity"), stage(known(usage), "usage")
    )


@query("mdl11_framework_days")
def mdl11_framework_days(spark, d):
    """Days until every agent's scores stay within tolerance: models of each day on the whole period, and load profiles."""
    trained = cold_starts(spark, d)
    named = F.when(F.col("device").isNull(), F.col("agent")).otherwise(F.concat("agent", F.lit("_"), agent_key(F.col("device"))))
    load_scores = Prepared(spark, d).distances().select(
        "household_id", F.concat(F.lit("load_"), agent_key(F.col("device"))).alias("agent"), "day", F.col("distance").alias("score")
    )
    scores = stage(trained.select("household_id", named.alias("agent"), "day", "score").unionByName(load_scores), "scores")
    days = metrics.cold_start_days(scores, ["household_id", "agent"], TOLERANCES, F.col("agent").startswith("load_"))
    return metrics.framework_days(days, ["household_id"])


def model_recommendations(spark, d):
    """Recommendations of the daily refitted models, and the written predictions that they come from."""
    t = Prepared(spark, d)
    activity, usage = explained_models(spark, d)
    hours = activity.select("household_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "p")
    inputs = decide.day_inputs(t.profiles(), t.prices(), hours, usage.select(*KEY, "p"))
    return decide.recommend(decide.with_costs(inputs), 0.25, 0.375), activity, usage


@query("rec2_model_explained")
def rec2_model_explained(spark, d):
    """Recommendations with the reasons of the very models that made them, at the recommended hour, in words."""
    recommended, activity, usage = model_recommendations(spark, d)
    path = _new_path(spark, "weather")
    tables.write_unscaled_weather(V.weather(spark, d), path)

    def reasons(df, ids, columns, unit, ts):
        own = per_entity.own_attributions(df, ids, columns)
        return explained.with_unscaled(own, tables.read_unscaled(spark, path, unit), ts)

    return explained.with_sentences(
        stage(recommended, "recommended"),
        reasons(activity, ["household_id", "ts"], [*ACTIVITY_COLUMNS, *WEATHER], "hour", F.col("ts")),
        reasons(usage, KEY, USAGE_COLUMNS, "day", F.col("day").cast("timestamp_ntz")),
    )


@query("xai5_model_hour")
def xai5_model_hour(spark, d):
    """What each feature adds to the log odds of activity at the recommended hour, strongest first, by the recommending model."""
    recommended, activity, _ = model_recommendations(spark, d)
    reasons = per_entity.own_attributions(activity, ["household_id", "ts"], [*ACTIVITY_COLUMNS, *WEATHER])
    ranked = explained.at_recommended_hour(stage(recommended, "recommended"), reasons)
    return ranked.select(*KEY, "best_launch_hour", "feature", "value", "attribution", "rank")


REC_EXPLAINED_SQL = (
    "SELECT r.household_id, r.device, r.day, r.best_launch_hour, r.recommendation,"
    " a.sentence AS activity_sentence, u.sentence AS usage_sentence"
    f" FROM (SELECT * FROM recs WHERE {PAIR}) r LEFT JOIN ({XAI6_SQL}) a ON a.household_id = r.household_id"
    "  AND a.ts = CAST(r.day AS TIMESTAMP) + to_hours(r.best_launch_hour)"
    f" LEFT JOIN ({XAI7_SQL}) u ON u.household_id = r.household_id AND u.device = r.device AND u.day = r.day"
)


@query("rec_explained", REC_EXPLAINED_SQL)
def rec_explained(spark, d):
    """Recommendations with the reasons at their own hour, in words."""
    t = Prepared(spark, d)
    return explained.with_sentences(
        t.recommended(), unscaled(activity_attributions(spark, d)), unscaled(usage_attributions(spark, d))
    )


@query(
    "xai5_recommended_hour",
    "SELECT r.household_id, r.device, r.day, r.best_launch_hour, a.feature, round(a.attribution, 8) AS attribution,"
    " CAST(row_number() OVER (PARTITION BY r.household_id, r.device, r.day ORDER BY a.attribution DESC NULLS LAST, a.feature)"
    f" AS INT) AS rank FROM (SELECT * FROM recs WHERE {PAIR}) r JOIN ({ACTIVITY_ATTR_SQL}) a"
    " ON a.household_id = r.household_id AND a.ts = CAST(r.day AS TIMESTAMP) + to_hours(r.best_launch_hour)",
)
def xai5_recommended_hour(spark, d):
    """All features of the activity score at the recommended hour, strongest first."""
    ranked = explained.at_recommended_hour(Prepared(spark, d).recommended(), activity_attributions(spark, d))
    return rounded(ranked.select(*KEY, "best_launch_hour", "feature", "attribution", "rank"), 8)
