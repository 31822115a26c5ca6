"""Queries on sources, cleaning, resampling, features, joins and aggregates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthgrid.catalog import views as V
from hearthgrid.catalog.registry import query, rounded
from hearthgrid.config import WEEKDAY_DUMMIES, WEATHER_COLUMNS
from hearthgrid.functions.exprs import above, agent_key
from hearthgrid.functions.times import is_weekend, weekday_dummies
from hearthgrid.operators import clean, features, resample
from hearthgrid.operators.impute import knn_impute
from hearthgrid.operators.prices import hourly_mean_price, replicate_years
from hearthgrid.operators.runs import drop_partial_first_day
from hearthgrid.plans import prepare
from hearthgrid.plans.dates import date_bounds, from_date, min_start, timespan
from hearthgrid.session import stage, stage_by, staged_bytes, staging_dir
from hearthgrid.sources import meter, tables

METER = ["household_id", "appliance"]
WEATHER = list(WEATHER_COLUMNS)
APPLIANCES = list(V.CONFIG.active_appliances)


# The written hourly tables of each application, data directory and way to fill.
_HOURLY: dict[tuple[str, str, str], DataFrame] = {}


def hourly(spark: SparkSession, sf_dir: str, fill: str = "zero") -> DataFrame:
    """Hourly readings, written once in an application and read by all queries on the directory."""
    key = (spark.sparkContext.applicationId, sf_dir, fill)
    if key not in _HOURLY:
        # a household has a bounded number of hours
        readings = V.readings(spark, sf_dir)
        size = staged_bytes(V.table(spark, sf_dir, "events"))
        _HOURLY[key] = stage_by(prepare.hourly_readings(readings, fill=fill), "household_id", "hourly", size)
    return _HOURLY[key]


def forget(spark: SparkSession) -> None:
    """Let the next query write its hourly table anew."""
    for key in [k for k in _HOURLY if k[0] == spark.sparkContext.applicationId]:
        del _HOURLY[key]


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.activity_flag(
        hourly(spark, sf_dir), V.CONFIG.activity_threshold, APPLIANCES
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.daily_usage(hourly(spark, sf_dir), V.CONFIG)


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.load_frame(hourly(spark, sf_dir), V.CONFIG)


def column_name(c):
    return F.lower(F.replace(c, F.lit(" "), F.lit("_")))


WIDE = [a.lower().replace(" ", "_") for a in APPLIANCES]
WIDE_SQL = ", ".join(
    f"round(max(watts) FILTER (WHERE appliance = '{a}'), 6) AS {a.lower().replace(' ', '_')}"
    for a in APPLIANCES
)


# --- sources -------------------------------------------------------------------------


@query(
    "src1_wide",
    f"SELECT household_id, ts, {WIDE_SQL} FROM hourly GROUP BY household_id, ts",
)
def src1_wide(spark, d):
    named = hourly(spark, d).withColumn("name", column_name(F.col("appliance")))
    return rounded(meter.to_wide(named, ["household_id", "ts"], WIDE, "name"))


@query(
    "src3_melt",
    "SELECT household_id, ts, lower(replace(appliance, ' ', '_')) AS slot,"
    " round(watts, 6) AS watts FROM hourly",
)
def src3_melt(spark, d):
    return rounded(meter.melt(src1_wide(spark, d), ["household_id", "ts"], WIDE))


@query(
    "src2_labels",
    "SELECT household_id, CAST(row_number() OVER (PARTITION BY household_id ORDER BY appliance) AS INT)"
    " AS slot, appliance FROM (SELECT DISTINCT household_id, appliance FROM readings)"
    " UNION ALL SELECT DISTINCT household_id, 0, 'Aggregate' FROM readings",
)
def src2_labels(spark, d):
    """One readme text per household, written from the readings and parsed back."""
    w = Window.partitionBy("household_id").orderBy("appliance")
    numbered = V.readings(spark, d).select(*METER).distinct().select(
        *METER, F.row_number().over(w).alias("slot")
    )
    items = numbered.groupBy("household_id").agg(
        F.array_sort(F.collect_list(F.struct("slot", "appliance"))).alias("items")
    )
    entries = F.transform(
        "items", lambda i: F.concat(i["slot"].cast("string"), F.lit("."), i["appliance"])
    )
    text = F.concat(
        F.lit("List\n\nHouse "), F.col("household_id").cast("string"),
        F.lit("\n0.Aggregate, "), F.concat_ws(", ", entries), F.lit("\n\t!NOTES\n\t\t1. moved"),
    )
    return meter.parse_appliance_labels(items.select(text.alias("value")), "value")


@query("src4_price_parse", "SELECT ts, price FROM prices")
def src4_price_parse(spark, d):
    """Interval texts written from the price rows and parsed back."""
    fmt = "dd.MM.yyyy HH:mm"
    end = F.col("ts") + F.expr("interval 1 hour")
    texts = V.prices(spark, d).select(
        F.concat(F.date_format("ts", fmt), F.lit(" - "), F.date_format(end, fmt)).alias("mtu"),
        "price",
    )
    return texts.select(tables.interval_start(F.col("mtu"), fmt).alias("ts"), "price")


@query(
    "src5_price_years",
    "SELECT ts - INTERVAL 2 YEAR AS ts, price FROM prices UNION ALL"
    " SELECT ts - INTERVAL 1 YEAR AS ts, price FROM prices UNION ALL SELECT ts, price FROM prices",
)
def src5_price_years(spark, d):
    return replicate_years(V.prices(spark, d), 2024, [2022, 2023])


@query("src6_weather", "SELECT * FROM weather")
def src6_weather(spark, d):
    """The weather written as a user's CSV and Parquet file and read back; both must agree."""
    path = f"{staging_dir(spark).rstrip('/')}/weather-{uuid.uuid4().hex}"
    table = stage(V.weather(spark, d), "weather")
    table.write.parquet(f"{path}/parquet")
    table.withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).write.option("header", True).csv(f"{path}/csv")
    read = tables.read_weather(spark, f"{path}/parquet")
    return read.intersectAll(tables.read_weather(spark, f"{path}/csv", "csv"))


@query(
    "src8_legend",
    "SELECT household_id AS household, max(device) FILTER (WHERE pos = 0) AS device_0,"
    " max(device) FILTER (WHERE pos = 1) AS device_1, max(device) FILTER (WHERE pos = 2) AS device_2"
    " FROM (SELECT household_id, appliance AS device,"
    " row_number() OVER (PARTITION BY household_id ORDER BY count(*) DESC, appliance) - 1 AS pos"
    " FROM readings WHERE appliance IN ('Washing Machine', 'Tumble Dryer', 'Dishwasher')"
    " GROUP BY household_id, appliance) GROUP BY household_id",
)
def src8_legend(spark, d):
    """Configuration documents written as JSON files from the readings and read back.

    The devices of a household are listed by number of readings.
    """
    counts = (
        V.readings(spark, d)
        .where(F.col("appliance").isin(*V.CONFIG.shiftable_devices))
        .groupBy(*METER)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = counts.groupBy("household_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("appliance")))).alias("r")
    )
    doc = F.to_json(
        F.struct(
            F.struct(F.col("household_id").alias("household")).alias("data"),
            F.struct(
                F.transform("r", lambda x: x["appliance"]).alias("shiftable_devices")
            ).alias("user_input"),
        )
    )
    path = f"{staging_dir(spark).rstrip('/')}/configs-{uuid.uuid4().hex}"
    ranked.select(doc.alias("value")).write.text(path)
    return tables.device_legend(tables.read_configs(spark, path, lines=True), 3)


# --- filters -------------------------------------------------------------------------


@query(
    "flt1_timespan",
    "SELECT household_id, appliance, ts, watts FROM readings"
    " WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-07 12:00:00'",
)
def flt1_timespan(spark, d):
    return timespan(V.readings(spark, d), "2024-01-05 00:00:00", days=2, hours=12)


@query(
    "flt2_from_date",
    "SELECT household_id, appliance, ts, watts FROM readings WHERE ts >= TIMESTAMP '2024-01-20'",
)
def flt2_from_date(spark, d):
    return from_date(V.readings(spark, d), "2024-01-20")


@query(
    "flt6_day_mask",
    "SELECT household_id, appliance, ts, round(watts, 6) AS watts FROM hourly"
    " WHERE scaled > 0.5 AND strftime(ts, '%Y-%m-%d') = '2024-01-20'",
)
def flt6_day_mask(spark, d):
    on_day = F.to_date("ts") == F.lit("2024-01-20").cast("date")
    rows = hourly(spark, d).where(on_day & (F.col("scaled") > 0.5))
    return rounded(rows.select(*METER, "ts", "watts"))


@query(
    "flt7_device_usage",
    "SELECT household_id, appliance, ts, CAST(scaled > 0.8 AS INT) AS usage FROM hourly",
)
def flt7_device_usage(spark, d):
    return hourly(spark, d).select(
        *METER, "ts", above(F.col("scaled"), V.CONFIG.device_threshold).alias("usage")
    )


@query(
    "flt8_drop_null",
    "SELECT * FROM weather WHERE temp IS NOT NULL AND dwpt IS NOT NULL AND rhum IS NOT NULL",
)
def flt8_drop_null(spark, d):
    return V.weather(spark, d).na.drop()


@query("flt9_all_null_columns", "SELECT ts, temp, dwpt, rhum, wdir, wspd FROM weather")
def flt9_all_null_columns(spark, d):
    with_empty = V.weather(spark, d).withColumn("snow", F.when(F.col("wspd") < 0, F.col("wspd")))
    return clean.drop_all_null_columns(with_empty)


@query(
    "flt10_partial_day",
    "SELECT household_id, device, ts, round(load, 6) AS load FROM whole_load",
)
def flt10_partial_day(spark, d):
    return rounded(drop_partial_first_day(load(spark, d)))


@query(
    "flt12_date_bounds",
    "SELECT household_id, CAST(min(ts) AS DATE) + 1 AS first_date,"
    " CAST(max(ts) AS DATE) - 1 AS last_date FROM readings GROUP BY household_id",
)
def flt12_date_bounds(spark, d):
    return date_bounds(V.readings(spark, d))


@query(
    "flt13_min_start",
    "SELECT a.household_id, activity_start, usage_start, load_start,"
    " greatest(activity_start, usage_start, load_start) AS combined FROM"
    " (SELECT household_id, CAST(min(ts) AS DATE) AS activity_start FROM activity_lags"
    "  WHERE lag72 IS NOT NULL AND hour = 0 GROUP BY ALL) a JOIN"
    " (SELECT household_id, min(day) AS usage_start FROM"
    "  (SELECT household_id, day, lag(usage, 3) OVER (PARTITION BY household_id, device ORDER BY day) AS l"
    "   FROM usage) WHERE l IS NOT NULL GROUP BY ALL) u ON a.household_id = u.household_id JOIN"
    " (SELECT household_id, CAST(min(ts) AS DATE) AS load_start FROM device_load WHERE hour(ts) = 0"
    "  GROUP BY ALL) l ON a.household_id = l.household_id",
)
def flt13_min_start(spark, d):
    from hearthgrid.session import stage

    h = stage(hourly(spark, d), "hourly")
    frames = {
        "activity": prepare.activity_features(h, V.CONFIG),
        "usage": prepare.usage_features(h, V.CONFIG).withColumn(
            "ts", F.col("day").cast("timestamp_ntz")
        ),
        "load": prepare.load_frame(h, V.CONFIG),
    }
    return min_start(frames)


# --- cleaning ------------------------------------------------------------------------


@query("cln1_truncate", "SELECT household_id, appliance, ts, round(watts, 6) AS watts FROM cleaned")
def cln1_truncate(spark, d):
    return rounded(clean.truncate_outliers(V.readings(spark, d), METER))


@query(
    "cln1_bounds",
    "SELECT household_id, appliance, round(q1, 6) AS q1, round(q3, 6) AS q3,"
    " round(lower, 6) AS lower, round(upper, 6) AS upper FROM bounds",
)
def cln1_bounds(spark, d):
    return rounded(clean.outlier_bounds(V.readings(spark, d), METER))


@query(
    "cln2_outlier_count",
    "SELECT r.household_id, r.appliance,"
    " count(*) FILTER (WHERE watts <> 0 AND (watts > upper OR watts < lower)) AS n_outliers,"
    " count(watts) AS n_values FROM readings r JOIN bounds b ON r.household_id = b.household_id"
    " AND r.appliance = b.appliance GROUP BY ALL",
)
def cln2_outlier_count(spark, d):
    return clean.outlier_counts(V.readings(spark, d), METER)


@query(
    "cln3_minmax",
    "SELECT household_id, appliance, ts, watts, round((watts - mn) / (mx - mn), 6) AS scaled FROM"
    " (SELECT *, min(watts) OVER w AS mn, max(watts) OVER w AS mx FROM readings"
    "  WINDOW w AS (PARTITION BY household_id, appliance))",
)
def cln3_minmax(spark, d):
    out = clean.scale_minmax(V.readings(spark, d), METER)
    return out.select(*METER, "ts", "watts", F.round("scaled", 6).alias("scaled"))


def _impute_sql() -> str:
    """k nearest rows by scaled euclidean distance over the columns both rows have."""
    cols = WEATHER
    shared = " + ".join(f"CAST(a.{c} IS NOT NULL AND b.{c} IS NOT NULL AS INT)" for c in cols)
    square = " + ".join(f"coalesce((a.{c} - b.{c}) * (a.{c} - b.{c}), 0)" for c in cols)
    parts = []
    for c in cols:
        parts.append(
            f"SELECT a.ts, '{c}' AS name, b.{c} AS v, b.ts AS donor,"
            f" sqrt({len(cols)}.0 / ({shared}) * ({square})) AS dist"
            f" FROM weather a JOIN weather b ON a.{c} IS NULL AND b.{c} IS NOT NULL AND ({shared}) > 0"
        )
    pairs = " UNION ALL ".join(parts)
    fills = (
        f"SELECT ts, name, CASE WHEN min(dist) = 0 THEN avg(v) FILTER (WHERE dist = 0)"
        f" ELSE sum(v / nullif(dist, 0)) / sum(1 / nullif(dist, 0)) END AS v FROM"
        f" (SELECT * FROM ({pairs}) QUALIFY row_number() OVER (PARTITION BY ts, name ORDER BY dist, donor) <= 7)"
        f" GROUP BY ts, name"
    )
    picks = ", ".join(
        f"round(coalesce(any_value(w.{c}), max(f.v) FILTER (WHERE f.name = '{c}')), 9) AS {c}"
        for c in cols
    )
    return f"SELECT w.ts, {picks} FROM weather w LEFT JOIN ({fills}) f ON w.ts = f.ts GROUP BY w.ts"


@query("cln4_knn_impute", _impute_sql())
def cln4_knn_impute(spark, d):
    return rounded(knn_impute(V.weather(spark, d), "ts", WEATHER), 9)


def _households_weather(spark, d):
    frame = activity(spark, d).select("household_id", "ts")
    return prepare.join_weather(frame, V.weather(spark, d))


@query(
    "cln5_backfill",
    "SELECT a.household_id, a.ts, "
    + ", ".join(
        f"first_value(w.{c} IGNORE NULLS) OVER (PARTITION BY a.household_id ORDER BY a.ts"
        f" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}"
        for c in WEATHER
    )
    + " FROM activity a LEFT JOIN weather w ON a.ts = w.ts",
)
def cln5_backfill(spark, d):
    return clean.backfill(_households_weather(spark, d), ["household_id"], WEATHER)


@query(
    "cln6_gap_fill",
    "SELECT household_id, appliance, ts, CASE WHEN last_ts IS NULL THEN NULL"
    " WHEN ts - last_ts > INTERVAL 1 HOUR THEN 0 ELSE last_v END AS watts FROM"
    " (SELECT household_id, appliance, ts,"
    "   last_value(CASE WHEN watts IS NOT NULL THEN ts END IGNORE NULLS) OVER w AS last_ts,"
    "   last_value(watts IGNORE NULLS) OVER w AS last_v"
    "  FROM (SELECT household_id, appliance, ts,"
    "          CASE WHEN minute(ts) % 3 = 1 THEN NULL ELSE watts END AS watts"
    "        FROM readings) WHERE watts IS NULL OR watts <= 2000"
    "  WINDOW w AS (PARTITION BY household_id, appliance ORDER BY ts"
    "               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
)
def cln6_gap_fill(spark, d):
    """Readings taken in every third minute count as unknown."""
    holes = V.readings(spark, d).withColumn(
        "watts", F.when(F.minute("ts") % 3 != 1, F.col("watts"))
    )
    return clean.forward_fill(holes, METER, max_gap_seconds=3600, max_value=2000.0)


@query(
    "cln7_profile",
    "SELECT household_id, appliance, count(*) AS n_rows, count(*) - count(watts) AS n_null,"
    " round(avg(watts), 6) AS mean, round(stddev_samp(watts), 6) AS std, min(watts) AS min,"
    " max(watts) AS max, round(quantile_cont(watts, 0.25), 6) AS p25,"
    " round(quantile_cont(watts, 0.5), 6) AS p50, round(quantile_cont(watts, 0.75), 6) AS p75"
    " FROM readings WHERE watts <> 0 GROUP BY household_id, appliance",
)
def cln7_profile(spark, d):
    used = V.readings(spark, d).where(F.col("watts") != 0)
    out = clean.profile(used, METER, "watts")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")})


@query(
    "cln8_histogram",
    "SELECT household_id, appliance,"
    " CAST(least(floor((watts - mn) / (mx - mn) * 50), 49) AS INT) AS bin, count(*) AS n FROM"
    " (SELECT *, min(watts) OVER w AS mn, max(watts) OVER w AS mx FROM readings"
    "  WINDOW w AS (PARTITION BY household_id, appliance)) GROUP BY ALL",
)
def cln8_histogram(spark, d):
    return clean.histogram(V.readings(spark, d), METER, "watts")


# --- grids and features --------------------------------------------------------------


@query(
    "res1_hourly",
    "SELECT g.household_id, g.appliance, g.ts, round(h.watts, 6) AS watts FROM"
    " (SELECT m.household_id, m.appliance, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts"
    "  FROM members m JOIN spans s ON m.household_id = s.household_id) g LEFT JOIN"
    " (SELECT household_id, appliance, date_trunc('hour', ts) AS ts, avg(watts) AS watts FROM readings"
    "  GROUP BY ALL) h ON g.household_id = h.household_id AND g.appliance = h.appliance AND g.ts = h.ts",
)
def res1_hourly(spark, d):
    return rounded(
        resample.resample_mean(V.readings(spark, d), METER, ["watts"], "hour", ["household_id"])
    )


@query(
    "res1_daily",
    "SELECT m.household_id, m.appliance, m.ts, round(avg(r.watts), 6) AS watts FROM"
    " (SELECT a.household_id, a.appliance, s.ts FROM (SELECT DISTINCT household_id, appliance FROM readings) a JOIN"
    "  (SELECT household_id, unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)),"
    "    INTERVAL 1 DAY))::TIMESTAMP AS ts FROM readings GROUP BY household_id) s USING (household_id)) m"
    " LEFT JOIN readings r ON r.household_id = m.household_id AND r.appliance = m.appliance"
    "  AND date_trunc('day', r.ts) = m.ts GROUP BY m.household_id, m.appliance, m.ts",
)
def res1_daily(spark, d):
    return rounded(
        resample.resample_mean(V.readings(spark, d), METER, ["watts"], "day", ["household_id"])
    )


@query(
    "res2_day_counts",
    "SELECT d.household_id, d.day, count(r.ts) AS n_rows FROM"
    " (SELECT household_id, unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE),"
    "   INTERVAL 1 DAY))::DATE AS day FROM readings GROUP BY household_id) d"
    " LEFT JOIN readings r ON d.household_id = r.household_id AND d.day = CAST(r.ts AS DATE) GROUP BY ALL",
)
def res2_day_counts(spark, d):
    return resample.day_counts(V.readings(spark, d), ["household_id"])


@query("fea1_activity", "SELECT household_id, ts, activity FROM activity")
def fea1_activity(spark, d):
    return activity(spark, d)


@query(
    "fea2_calendar",
    "SELECT household_id, ts, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS day_of_week,"
    " dayname(ts) AS day_name, CAST(month(ts) AS INT) AS month, monthname(ts) AS month_name FROM activity",
)
def fea2_calendar(spark, d):
    names = ["hour", "day_of_week", "day_name", "month", "month_name"]
    return features.add_calendar(activity(spark, d).drop("activity"), names)


@query(
    "fea3_lags",
    "SELECT household_id, ts, activity, lag24 AS activity_lag_24, lag48 AS activity_lag_48,"
    " lag72 AS activity_lag_72 FROM activity_lags",
)
def fea3_lags(spark, d):
    return features.add_lags(
        activity(spark, d), ["household_id"], ["activity"], V.CONFIG.activity_lags
    )


@query(
    "fea4_periods_since",
    "SELECT u.household_id, u.device, u.day, any_value(u.usage) AS usage,"
    " CASE WHEN any_value(u.rn) > 1 THEN CAST(any_value(u.rn) - coalesce(max(v.rn), 0) AS INT) END"
    " AS periods_since_last_usage FROM"
    " (SELECT *, row_number() OVER (PARTITION BY household_id, device ORDER BY day) AS rn FROM usage) u"
    " LEFT JOIN"
    " (SELECT *, row_number() OVER (PARTITION BY household_id, device ORDER BY day) AS rn FROM usage) v"
    " ON u.household_id = v.household_id AND u.device = v.device AND v.rn < u.rn AND v.usage <> 0"
    " GROUP BY u.household_id, u.device, u.day",
)
def fea4_periods_since(spark, d):
    return features.add_periods_since(
        usage(spark, d).drop("activity"), ["household_id", "device"], ["usage"], "day"
    )


@query(
    "fea5_active_2d",
    "SELECT household_id, device, day, CAST(coalesce(l1 = 1, false) OR coalesce(l2 = 1, false) AS INT)"
    " AS active_last_2_days FROM (SELECT household_id, device, day, lag(usage, 1) OVER w AS l1,"
    " lag(usage, 2) OVER w AS l2 FROM usage WINDOW w AS (PARTITION BY household_id, device ORDER BY day))",
)
def fea5_active_2d(spark, d):
    lagged = features.add_lags(
        usage(spark, d), ["household_id", "device"], ["usage"], (1, 2), "day"
    )
    return lagged.select(
        "household_id", "device", "day",
        features.active_last_2_days("usage").alias("active_last_2_days"),
    )


@query(
    "fea6_onehot",
    "SELECT household_id, ts, "
    + ", ".join(f"CAST(dayname(ts) = '{w}' AS INT) AS day_name_{w}" for w in WEEKDAY_DUMMIES)
    + " FROM activity",
)
def fea6_onehot(spark, d):
    return activity(spark, d).select("household_id", "ts", *weekday_dummies(F.col("ts")))


@query(
    "fea7_daily_flag",
    "SELECT household_id, device, day, CAST(avg(flag) > 0 AS INT) AS usage FROM"
    " (SELECT household_id, appliance AS device, CAST(ts AS DATE) AS day,"
    "  CASE WHEN scaled > 0.8 THEN 1 ELSE 0 END AS flag FROM hourly"
    "  WHERE appliance IN ('Washing Machine', 'Tumble Dryer', 'Dishwasher')) GROUP BY ALL",
)
def fea7_daily_flag(spark, d):
    return usage(spark, d).drop("activity")


@query(
    "fea8_weather",
    "SELECT day, round(temp, 6) AS temp, round(dwpt, 6) AS dwpt, round(rhum, 6) AS rhum,"
    " round(wdir, 6) AS wdir, round(wspd, 6) AS wspd FROM weather_days",
)
def fea8_weather(spark, d):
    return rounded(prepare.daily_weather(V.weather(spark, d)))


@query(
    "fea8_weather_midnight",
    "SELECT CAST(ts AS DATE) AS day, temp, dwpt, rhum, wdir, wspd FROM weather WHERE hour(ts) = 0",
)
def fea8_weather_midnight(spark, d):
    return prepare.daily_weather(V.weather(spark, d), "midnight")


@query(
    "fea9_device_load",
    "SELECT household_id, device, ts, round(load, 6) AS load FROM device_load",
)
def fea9_device_load(spark, d):
    return rounded(load(spark, d))


THRESHOLDS = [0.0, 0.01, 0.025, 0.063, 0.16, 0.4]


@query(
    "fea10_threshold_profile",
    "SELECT threshold, x.d AS dimension, x.b AS bucket, series, round(avg(flag), 6) AS ratio FROM"
    " (SELECT threshold, series, flag, unnest([{'d': 'hour', 'b': CAST(hour(ts) AS INT)},"
    "   {'d': 'weekday', 'b': CAST(isodow(ts) - 1 AS INT)}, {'d': 'month', 'b': CAST(month(ts) AS INT)}])"
    "   AS x FROM"
    "  (SELECT ts, threshold, appliance || '_usage' AS series, CAST(scaled > threshold AS INT) AS flag"
    f"   FROM hourly CROSS JOIN (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS threshold)"
    "   UNION ALL SELECT ts, threshold, 'activity', CAST(max(scaled) > threshold AS INT)"
    f"   FROM hourly CROSS JOIN (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS threshold)"
    "   GROUP BY household_id, ts, threshold)) GROUP BY ALL",
)
def fea10_threshold_profile(spark, d):
    return features.threshold_profile(hourly(spark, d), THRESHOLDS, APPLIANCES).withColumn(
        "ratio", F.round("ratio", 6)
    )


@query(
    "fea11_weekend",
    "SELECT household_id, ts, CAST(isodow(ts) IN (6, 7) AS INT) AS weekend FROM activity",
)
def fea11_weekend(spark, d):
    return activity(spark, d).select("household_id", "ts", is_weekend(F.col("ts")).alias("weekend"))


_BACKFILLED = ", ".join(
    "round(first_value(w.{c} IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY {order}"
    " ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS {c}".replace("{c}", c)
    for c in WEATHER
)
_DUMMIES = ", ".join(f"CAST(dayname({{t}}) = '{w}' AS INT) AS day_name_{w}" for w in WEEKDAY_DUMMIES)


@query(
    "pipe1_activity",
    "SELECT l.household_id, l.ts, l.activity, l.hour, lag24 AS activity_lag_24,"
    " lag48 AS activity_lag_48, lag72 AS activity_lag_72, "
    + _DUMMIES.replace("{t}", "l.ts") + ", "
    + _BACKFILLED.replace("{keys}", "l.household_id").replace("{order}", "l.ts")
    .replace("round(", "").replace(", 6) AS", " AS")
    + " FROM activity_lags l LEFT JOIN weather w ON l.ts = w.ts",
)
def pipe1_activity(spark, d):
    return prepare.activity_features(hourly(spark, d), V.CONFIG, V.weather(spark, d))


@query(
    "pipe2_load",
    "SELECT household_id, ts, "
    + ", ".join(
        f"round(sum(load) FILTER (WHERE device = '{v}'), 6) AS {v.lower().replace(' ', '_')}"
        for v in V.CONFIG.shiftable_devices
    )
    + " FROM device_load GROUP BY household_id, ts",
)
def pipe2_load(spark, d):
    names = [v.lower().replace(" ", "_") for v in V.CONFIG.shiftable_devices]
    named = load(spark, d).withColumn("name", agent_key(F.col("device")))
    return rounded(meter.to_wide(named, ["household_id", "ts"], names, "name", "load"))


_USAGE_LAGS = ", ".join(
    f"lag({c}, {k}) OVER w AS {c}_lag_{k}" for c in ("activity", "usage") for k in (1, 2, 3)
)


@query(
    "pipe3_usage",
    "SELECT u.household_id, u.device, u.day, usage, activity, 0 AS hour,"
    " CASE WHEN rn > 1 THEN CAST(rn - coalesce(last_a, 0) AS INT) END AS periods_since_last_activity,"
    " CASE WHEN rn > 1 THEN CAST(rn - coalesce(last_u, 0) AS INT) END AS periods_since_last_usage,"
    " activity_lag_1, activity_lag_2, activity_lag_3, usage_lag_1, usage_lag_2, usage_lag_3,"
    " CAST(coalesce(activity_lag_1, 0) = 1 OR coalesce(activity_lag_2, 0) = 1 AS INT) AS active_last_2_days, "
    + _DUMMIES.replace("{t}", "u.day") + ", "
    + _BACKFILLED.replace("{keys}", "u.household_id, u.device").replace("{order}", "u.day")
    + " FROM (SELECT *, max(CASE WHEN activity <> 0 THEN rn END) OVER b AS last_a,"
    "  max(CASE WHEN usage <> 0 THEN rn END) OVER b AS last_u FROM"
    f"  (SELECT *, row_number() OVER w AS rn, {_USAGE_LAGS} FROM usage"
    "   WINDOW w AS (PARTITION BY household_id, device ORDER BY day))"
    "  WINDOW b AS (PARTITION BY household_id, device ORDER BY day"
    "               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) u"
    " LEFT JOIN weather_days w ON u.day = w.day",
)
def pipe3_usage(spark, d):
    return rounded(prepare.usage_features(hourly(spark, d), V.CONFIG, V.weather(spark, d)))


# --- joins and aggregates ------------------------------------------------------------


@query(
    "jn1_weather_left",
    "SELECT a.household_id, a.ts, temp, dwpt, rhum, wdir, wspd FROM activity a"
    " LEFT JOIN weather w ON a.ts = w.ts",
)
def jn1_weather_left(spark, d):
    return _households_weather(spark, d)


@query(
    "jn2_weather_right",
    "SELECT w.ts, a.household_id, a.activity, temp, dwpt, rhum, wdir, wspd FROM activity a"
    " RIGHT JOIN weather w ON a.ts = w.ts",
)
def jn2_weather_right(spark, d):
    return prepare.weather_rows_kept(activity(spark, d), V.weather(spark, d))


@query(
    "agg1_hourly_means",
    "SELECT hour, round(price, 6) AS price, round(activity, 6) AS activity FROM"
    " (SELECT CAST(hour(ts) AS INT) AS hour, avg(price) AS price FROM prices GROUP BY ALL) JOIN"
    " (SELECT CAST(hour(ts) AS INT) AS hour, avg(activity) AS activity FROM activity GROUP BY ALL)"
    " USING (hour)",
)
def agg1_hourly_means(spark, d):
    active = features.group_mean(activity(spark, d), [F.hour("ts").alias("hour")], ["activity"])
    return rounded(hourly_mean_price(V.prices(spark, d)).join(active, "hour"))


@query(
    "agg6_uses_per_day",
    "SELECT device, uses, count(*) AS n_days FROM"
    " (SELECT household_id, device, CAST(ts AS DATE) AS day, count(*) AS uses FROM device_load"
    "  WHERE load > 0 GROUP BY ALL) GROUP BY device, uses",
)
def agg6_uses_per_day(spark, d):
    return features.uses_per_day(load(spark, d)).groupBy("device", "uses").agg(
        F.count(F.lit(1)).alias("n_days")
    )


CORR = ["washing_machine", "tumble_dryer", "dishwasher", *WEATHER]


def _corr_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(CORR) for b in CORR[i + 1:]]
    picks = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM flags" for a, b in pairs
    )
    flags = ", ".join(
        f"max(CAST(scaled > 0.8 AS INT)) FILTER (WHERE appliance = '{v}') AS {v.lower().replace(' ', '_')}"
        for v in V.CONFIG.shiftable_devices
    )
    return (
        f"SELECT a, b, corr FROM (WITH flags AS (SELECT f.*, w.* EXCLUDE (ts) FROM"
        f" (SELECT household_id, ts, {flags} FROM hourly GROUP BY household_id, ts) f"
        f" LEFT JOIN weather w ON f.ts = w.ts) {picks})"
    )


@query("agg7_corr", _corr_sql())
def agg7_corr(spark, d):
    names = CORR[:3]
    named = hourly(spark, d).select(
        "household_id", "ts", agent_key(F.col("appliance")).alias("name"),
        above(F.col("scaled"), V.CONFIG.device_threshold).alias("flag"),
    )
    wide = meter.to_wide(named, ["household_id", "ts"], names, "name", "flag")
    return rounded(features.correlations(prepare.join_weather(wide, V.weather(spark, d)), CORR))


@query(
    "rec5_agent_key",
    "SELECT DISTINCT appliance AS device,"
    " 'usage_' || lower(replace(replace(replace(appliance, ' ', '_'), '(', ''), ')', '')) AS agent"
    " FROM readings",
)
def rec5_agent_key(spark, d):
    return V.readings(spark, d).select(
        F.col("appliance").alias("device"),
        F.concat(F.lit("usage_"), agent_key(F.col("appliance"))).alias("agent"),
    ).distinct()
