"""Queries on runs, profiles, prices, recommendations, their evaluation and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgrid.catalog import views as V
from hearthgrid.catalog.preparation import hourly
from hearthgrid.catalog.registry import NUDGE, query, rounded
from hearthgrid.config import GRID_THRESHOLDS
from hearthgrid.functions.exprs import saving_percent
from hearthgrid.functions.vectors import run_cost
from hearthgrid.operators import features, metrics, runs
from hearthgrid.operators.prices import day_ahead, price_matrix, price_vectors
from hearthgrid.operators.runs import DEVICE, HOURS
from hearthgrid.plans import decide, prepare
from hearthgrid.session import attach, stage

KEY = [*DEVICE, "day"]
APPLIANCES = list(V.CONFIG.active_appliances)


class Prepared:
    """Prepared tables of a data directory; all branches read one written hourly table."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.hourly = hourly(spark, sf_dir)

    def activity(self) -> DataFrame:
        return features.activity_flag(self.hourly, V.CONFIG.activity_threshold, APPLIANCES)

    def usage(self) -> DataFrame:
        return prepare.daily_usage(self.hourly, V.CONFIG)

    def load(self) -> DataFrame:
        return prepare.load_frame(self.hourly, V.CONFIG)

    def runs(self) -> DataFrame:
        return runs.runs(self.load())

    def profiles(self) -> DataFrame:
        return runs.load_profiles(self.load())

    def prices(self) -> DataFrame:
        return V.prices(self.spark, self.sf_dir)

    def inputs(self) -> DataFrame:
        return decide.day_inputs(
            self.profiles(),
            self.prices(),
            decide.activity_frequency(self.activity()),
            decide.usage_frequency(self.usage()),
        )

    def costed(self) -> DataFrame:
        return decide.with_costs(self.inputs())

    def costed_with_truth(self) -> DataFrame:
        return decide.with_truth(self.costed(), self.usage(), self.activity(), self.runs())

    def recommended(self) -> DataFrame:
        return decide.recommend(self.costed(), 0.25, 0.375)

    def evaluated(self) -> DataFrame:
        return decide.evaluate(decide.recommend(self.costed_with_truth(), 0.25, 0.375))

    def grid(self) -> DataFrame:
        return decide.threshold_grid(self.costed_with_truth())

    def surrogates(self) -> DataFrame:
        """Hour frequency as the model, mean of three lags as its surrogate."""
        lags = features.add_lags(self.activity(), ["household_id"], ["activity"], (24, 48, 72))
        p = decide.activity_frequency(self.activity())
        lagged = lags.select(
            "household_id", "ts", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"),
            F.col("activity").alias("label"),
            ((F.col("activity_lag_24") + F.col("activity_lag_48") + F.col("activity_lag_72")) / 3.0)
            .alias("surrogate"),
        )
        return (
            lagged.join(p.withColumnRenamed("p", "model"), ["household_id", "day", "hour"])
            .where(F.col("model").isNotNull() & F.col("surrogate").isNotNull())
            .drop("day", "hour")
        )

    def distances(self) -> DataFrame:
        return metrics.profile_distance(self.profiles())


PAIR = "activity_threshold = 0.25 AND usage_threshold = 0.375"
H_SQL = ", ".join(f"round(max(load) FILTER (WHERE off = {i}) + {NUDGE}, 6) AS h{i + 1}" for i in range(24))


# --- runs and profiles ---------------------------------------------------------------


@query(
    "win2_starts",
    "SELECT household_id, device, ts, round(load, 6) AS load FROM stretches WHERE load > 0 AND prev = 0",
)
def win2_starts(spark, d):
    return rounded(runs.starts(Prepared(spark, d).load()))


@query(
    "win3_runs",
    "SELECT household_id, device, start_ts, CAST(off AS INT) AS \"offset\", round(load, 6) AS load FROM run_hours",
)
def win3_runs(spark, d):
    return rounded(runs.run_elements(Prepared(spark, d).runs()))


@query(
    "lod1_profile",
    f"SELECT household_id, device, day, any_value(n_runs) AS n_runs, {H_SQL} FROM profiles"
    " GROUP BY household_id, device, day",
)
def lod1_profile(spark, d):
    return rounded(Prepared(spark, d).profiles(), nudge=NUDGE)


@query(
    "agg4_mean_run",
    "SELECT r.device, CAST(o.off AS INT) AS \"offset\", round(coalesce(sum(h.load), 0) / any_value(r.n), 6) AS load FROM"
    " (SELECT device, count(*) AS n FROM run_hours WHERE off = 0 GROUP BY device) r CROSS JOIN offsets o"
    " LEFT JOIN run_hours h ON h.device = r.device AND h.off = o.off GROUP BY r.device, o.off",
)
def agg4_mean_run(spark, d):
    means = Prepared(spark, d).runs().groupBy("device").agg(
        *[F.expr(f"avg(load[{i}])").alias(h) for i, h in enumerate(HOURS)]
    )
    vector = F.array(*HOURS)
    long = means.select("device", F.posexplode(vector).alias("offset", "load"))
    return rounded(long)


# --- prices and costs ----------------------------------------------------------------


@query("prc1_price_48h", "SELECT day, slot, ts, price FROM price_days")
def prc1_price_48h(spark, d):
    return day_ahead(V.prices(spark, d))


@query(
    "win1_price_matrix",
    "SELECT p.day, p.slot AS hour, "
    + ", ".join(f"max(q.price) FILTER (WHERE q.slot = p.slot + {i}) AS price_at_h_{i}" for i in range(24))
    + " FROM price_days p JOIN price_days q ON p.day = q.day WHERE p.slot < 24 GROUP BY p.day, p.slot",
)
def win1_price_matrix(spark, d):
    return price_matrix(V.prices(spark, d))


@query(
    "cst1_cost",
    "SELECT household_id, device, day, start_hour, round(cost, 4) AS cost FROM costs",
)
def cst1_cost(spark, d):
    t = Prepared(spark, d)
    rows = t.profiles().select(*KEY, decide.profile_vector().alias("profile"))
    priced = attach(rows, stage(price_vectors(t.prices()), "prices"), ["day"])
    costs = priced.select(
        *KEY, F.posexplode(decide.start_costs("prices", "profile")).alias("start_hour", "cost")
    )
    return rounded(costs, 4)


@query(
    "cst2_run_cost",
    "SELECT household_id, device, day, run_hour AS hour, round(cost, 4) AS cost FROM run_costs"
    " WHERE at_hour = run_hour",
)
def cst2_run_cost(spark, d):
    t = Prepared(spark, d)
    rows = t.runs().select(
        *DEVICE, F.to_date("start_ts").alias("day"), F.hour("start_ts").alias("hour"), "load"
    )
    priced = attach(rows, stage(price_vectors(t.prices()), "prices"), ["day"])
    cost = run_cost("prices", "hour", "load")
    return rounded(priced.select(*KEY, "hour", cost.alias("cost")), 4)


@query(
    "cst3_saving_pct",
    "SELECT day, slot AS hour, round((1 - price / mean) * 100, 2) AS saving_percent FROM"
    " (SELECT *, avg(price) OVER (PARTITION BY day) AS mean FROM price_days WHERE slot < 24)",
)
def cst3_saving_pct(spark, d):
    v = price_vectors(V.prices(spark, d)).withColumn("prices", F.slice("prices", 1, 24))
    mean = F.aggregate("prices", F.lit(0.0), lambda a, x: a + x) / 24
    rows = v.select("day", mean.alias("mean"), F.posexplode("prices").alias("hour", "price"))
    return rows.select(
        "day", "hour", saving_percent(F.col("price"), F.col("mean")).alias("saving_percent")
    )


# --- recommendations -----------------------------------------------------------------


@query(
    "rec1_recommend",
    "SELECT household_id, device, day, best_launch_hour, no_recommend_flag_activity,"
    f" no_recommend_flag_usage, recommendation FROM recs WHERE {PAIR}",
)
def rec1_recommend(spark, d):
    return Prepared(spark, d).recommended().select(*decide.RECOMMENDATION)


@query(
    "rec3_errors",
    "SELECT 'recommendation' AS agent, household_id, device, day, reason FROM inputs WHERE reason IS NOT NULL",
)
def rec3_errors(spark, d):
    return decide.input_errors(Prepared(spark, d).inputs())


# The message must equal the expected text.
@query(
    "rec4_message",
    "SELECT r.household_id, r.device, r.day, r.recommendation,"
    " round((1 - p.price / m.mean) * 100, 2) AS saving_percent,"
    " CASE WHEN r.recommendation IS NULL THEN 'There is no recommendation for the device ' || r.device || ' .'"
    " ELSE 'You have a recommendation for the following device: ' || r.device || chr(10) || chr(10) ||"
    " 'Please use the device on the ' || strftime(r.day, '%d.%m.%Y') || ' at ' ||"
    " lpad(CAST(r.recommendation AS VARCHAR), 2, '0') || ':00 o''clock because it saves you ' ||"
    " CAST(round((1 - p.price / m.mean) * 100, 2) AS VARCHAR) ||"
    " ' % of costs compared to the mean of the day.' || chr(10) END AS message"
    f" FROM (SELECT * FROM recs WHERE {PAIR}) r"
    " JOIN (SELECT day, avg(price) AS mean FROM price_days WHERE slot < 24 GROUP BY day) m ON m.day = r.day"
    " LEFT JOIN price_days p ON p.day = r.day AND p.slot = r.recommendation",
)
def rec4_message(spark, d):
    return decide.messages(Prepared(spark, d).recommended())


# --- evaluation ----------------------------------------------------------------------


@query(
    "jn6_nearest_start",
    f"SELECT household_id, device, day, recommendation, relevant_start FROM relevant WHERE {PAIR}",
)
def jn6_nearest_start(spark, d):
    return Prepared(spark, d).evaluated().select(*KEY, "recommendation", "relevant_start")


@query(
    "evl1_acceptable",
    f"SELECT household_id, device, day, recommendation, acceptable FROM evaluated WHERE {PAIR}",
)
def evl1_acceptable(spark, d):
    return Prepared(spark, d).evaluated().select(*KEY, "recommendation", "acceptable")


@query(
    "evl2_starting_hours",
    "SELECT household_id, device, day, hour FROM day_starts",
)
def evl2_starting_hours(spark, d):
    days = decide.day_starts(Prepared(spark, d).runs())
    return days.select(*KEY, F.explode(F.transform("starts", lambda s: s["hour"])).alias("hour"))


@query(
    "evl4_savings",
    "SELECT household_id, device, day, round(cost_no_recommendation, 4) AS cost_no_recommendation,"
    " round(cost_recommendation, 4) AS cost_recommendation, round(savings, 4) AS savings,"
    f" round(relative_savings, 6) AS relative_savings FROM savings WHERE {PAIR}",
)
def evl4_savings(spark, d):
    out = Prepared(spark, d).evaluated().select(
        *KEY, "cost_no_recommendation", "cost_recommendation", "savings", "relative_savings"
    )
    return rounded(out, 4, relative_savings=6)


SUMMARY_SQL = (
    "n_recommendations, round(acceptable, 6) AS acceptable, round(total_savings, 3) AS total_savings,"
    " round(relative_savings_mean, 6) AS relative_savings_mean,"
    " round(relative_savings_median, 6) AS relative_savings_median"
)


@query("evl5_summary", f"SELECT household_id, {SUMMARY_SQL} FROM summary WHERE {PAIR}")
def evl5_summary(spark, d):
    return rounded(
        decide.summarise(Prepared(spark, d).evaluated(), ["household_id"]), 6, total_savings=3
    )


@query(
    "evl6_grid",
    f"SELECT household_id, activity_threshold, usage_threshold, {SUMMARY_SQL} FROM summary",
)
def evl6_grid(spark, d):
    return rounded(Prepared(spark, d).grid(), 6, total_savings=3)


@query(
    "agg8_sensitivity",
    "SELECT household_id, activity_threshold, "
    + ", ".join(
        f"round(max(total_savings) FILTER (WHERE usage_threshold = {t}), 3) AS usage_{str(t).replace('.', '_')}"
        for t in GRID_THRESHOLDS
    )
    + " FROM summary GROUP BY household_id, activity_threshold",
)
def agg8_sensitivity(spark, d):
    return rounded(
        decide.sensitivity(Prepared(spark, d).grid(), "total_savings"), 3, activity_threshold=6
    )


@query(
    "evl8_optimal",
    f"SELECT household_id, activity_threshold, usage_threshold, {SUMMARY_SQL},"
    " 'activity: ' || CAST(activity_threshold AS VARCHAR) || '; usage: ' ||"
    " CAST(usage_threshold AS VARCHAR) AS threshold_key FROM summary"
    " QUALIFY row_number() OVER (PARTITION BY household_id ORDER BY round(total_savings, 6) DESC NULLS LAST,"
    " activity_threshold DESC, usage_threshold DESC) = 1",
)
def evl8_optimal(spark, d):
    return rounded(decide.optimal_thresholds(Prepared(spark, d).grid()), 6, total_savings=3)


@query(
    "agg9_rec_hist",
    "SELECT activity_threshold, usage_threshold, recommendation, count(*) AS n FROM recs"
    " WHERE recommendation IS NOT NULL GROUP BY activity_threshold, usage_threshold, recommendation",
)
def agg9_rec_hist(spark, d):
    steps = F.array(*[F.lit(t) for t in GRID_THRESHOLDS])
    costed = Prepared(spark, d).costed()
    for name in ("activity_threshold", "usage_threshold"):
        costed = costed.withColumn(name, F.explode(steps))
    recommended = decide.recommend(costed, "activity_threshold", "usage_threshold")
    return decide.recommendation_hours(recommended, ["activity_threshold", "usage_threshold"])


@query(
    "agg5_daily_max_hour",
    "SELECT household_id, day, max(recommendation) AS latest, min(recommendation) AS earliest"
    f" FROM recs WHERE {PAIR} GROUP BY household_id, day",
)
def agg5_daily_max_hour(spark, d):
    return Prepared(spark, d).recommended().groupBy("household_id", "day").agg(
        F.max("recommendation").alias("latest"), F.min("recommendation").alias("earliest")
    )


# --- metrics -------------------------------------------------------------------------


def _auc_sql(source: str, keys: str, label: str, score: str, name: str = "auc") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    pick = f"{keys}, " if keys else ""
    return (
        f"SELECT {pick}round(CASE WHEN count(*) FILTER (WHERE y = 1) > 0 AND count(*) FILTER (WHERE y = 0) > 0"
        f" THEN (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)"
        f" / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) END, 6) AS {name} FROM"
        f" (SELECT *, rank() OVER ({part} ORDER BY s) + (count(*) OVER ({part}{' , ' if keys else 'PARTITION BY '}s) - 1) / 2.0 AS r"
        f"  FROM (SELECT *, {label} AS y, {score} AS s FROM {source})) "
        + (f"GROUP BY {keys}" if keys else "")
    )


@query("met1_auc", _auc_sql("scores", "", "label", "score"))
def met1_auc(spark, d):
    return rounded(metrics.auc(V.scores(spark, d), [], "label", "score"))


@query("met1_auc_by_household", _auc_sql("surrogates", "household_id", "label", "model"))
def met1_auc_by_household(spark, d):
    return rounded(metrics.auc(Prepared(spark, d).surrogates(), ["household_id"], "label", "model"))


@query("met4_auc_true", _auc_sql("surrogates", "household_id", "label", "surrogate", "auc_true"))
def met4_auc_true(spark, d):
    out = metrics.auc(Prepared(spark, d).surrogates(), ["household_id"], "label", "surrogate")
    return rounded(out.withColumnRenamed("auc", "auc_true"))


MSE_SQL = (
    "SELECT household_id, device, round(avg(err), 4) AS mse, count(*) AS n_runs FROM"
    " (SELECT s.household_id, s.device, s.day, s.hour, avg((coalesce(r.load, 0) - coalesce(p.load, 0))"
    "   * (coalesce(r.load, 0) - coalesce(p.load, 0))) AS err"
    "  FROM day_starts s CROSS JOIN offsets o"
    "  LEFT JOIN run_hours r ON r.household_id = s.household_id AND r.device = s.device"
    "   AND r.start_ts = CAST(s.day AS TIMESTAMP) + to_hours(s.hour) AND r.off = o.off"
    "  LEFT JOIN profiles p ON p.household_id = s.household_id AND p.device = s.device"
    "   AND p.day = s.day AND p.off = o.off GROUP BY ALL) GROUP BY household_id, device"
)


@query("met2_mse", MSE_SQL)
def met2_mse(spark, d):
    t = Prepared(spark, d)
    return rounded(metrics.load_mse(t.runs(), t.profiles()), 4)


@query(
    "met3_norm_euclid",
    "SELECT household_id, device, day, round(distance, 6) AS distance FROM distances",
)
def met3_norm_euclid(spark, d):
    return rounded(Prepared(spark, d).distances())


@query(
    "met5_fidelity",
    _auc_sql(
        "surrogates", "household_id", "CAST(model > 0.5 AS INT)", "CAST(surrogate > 0.5 AS INT)", "fidelity"
    ),
)
def met5_fidelity(spark, d):
    return rounded(
        metrics.fidelity(Prepared(spark, d).surrogates(), ["household_id"], "model", "surrogate")
    )


ERRORS_SQL = (
    "SELECT household_id, round(avg(abs(model - surrogate)), 6) AS maee,"
    " round(power(avg(model - surrogate), 2), 6) AS msee,"
    " round(avg((model - surrogate) * (model - surrogate)), 6) AS mse FROM surrogates GROUP BY household_id"
)


@query("met6_maee", f"SELECT household_id, maee FROM ({ERRORS_SQL})")
def met6_maee(spark, d):
    out = metrics.surrogate_errors(
        Prepared(spark, d).surrogates(), ["household_id"], "model", "surrogate"
    )
    return rounded(out.select("household_id", "maee"))


@query("met10_msee", f"SELECT household_id, msee, mse FROM ({ERRORS_SQL})")
def met10_msee(spark, d):
    out = metrics.surrogate_errors(
        Prepared(spark, d).surrogates(), ["household_id"], "model", "surrogate"
    )
    return rounded(out.select("household_id", "msee", "mse"))


CONFUSION_SQL = (
    "SELECT household_id, round(avg(CAST((model > 0.5) = (surrogate > 0.5) AS INT)), 6) AS accuracy,"
    " round(coalesce(count(*) FILTER (WHERE model > 0.5 AND surrogate > 0.5)"
    "  / nullif(count(*) FILTER (WHERE surrogate > 0.5), 0), 0), 6) AS precision,"
    " round(coalesce(count(*) FILTER (WHERE model > 0.5 AND surrogate > 0.5)"
    "  / nullif(count(*) FILTER (WHERE model > 0.5), 0), 0), 6) AS recall"
    " FROM surrogates GROUP BY household_id"
)


@query("met9_confusion", CONFUSION_SQL)
def met9_confusion(spark, d):
    return rounded(
        metrics.confusion_scores(
            Prepared(spark, d).surrogates(), ["household_id"], "model", "surrogate"
        )
    )


@query(
    "met8_score_table",
    "SELECT household_id, round(max(mse) FILTER (WHERE pos = 0), 4) AS device_0,"
    " round(max(mse) FILTER (WHERE pos = 1), 4) AS device_1,"
    " round(max(mse) FILTER (WHERE pos = 2), 4) AS device_2 FROM"
    " (SELECT *, row_number() OVER (PARTITION BY household_id ORDER BY device) - 1 AS pos"
    f"  FROM ({MSE_SQL})) GROUP BY household_id",
)
def met8_score_table(spark, d):
    t = Prepared(spark, d)
    return rounded(metrics.score_table(metrics.load_mse(t.runs(), t.profiles()), "mse", 3), 4)


TOLERANCES = [0.05, 0.1, 0.25, 0.5]


@query(
    "win4_cold_start_days",
    "SELECT household_id, device, tolerance, CAST(coalesce(max(rn) FILTER (WHERE NOT coalesce(distance < tolerance, false)), 0) + 1"
    " AS INT) AS cold_start_days FROM (SELECT *, row_number() OVER (PARTITION BY household_id, device ORDER BY day) AS rn"
    f" FROM distances) CROSS JOIN (SELECT unnest({TOLERANCES}::DOUBLE[]) AS tolerance) GROUP BY ALL",
)
def win4_cold_start_days(spark, d):
    scores = Prepared(spark, d).distances().withColumnRenamed("distance", "score")
    return metrics.cold_start_days(scores, DEVICE, TOLERANCES, F.lit(True))


@query(
    "evl9_cold_start_table",
    "SELECT household_id, device, "
    + ", ".join(
        f"CAST(coalesce(max(rn) FILTER (WHERE NOT coalesce(distance < {t}, false)), 0) + 1 AS INT)"
        f" AS days_{str(t).replace('.', '_')}"
        for t in TOLERANCES
    )
    + " FROM (SELECT *, row_number() OVER (PARTITION BY household_id, device ORDER BY day) AS rn"
    " FROM distances) GROUP BY household_id, device",
)
def evl9_cold_start_table(spark, d):
    return metrics.cold_start_table(win4_cold_start_days(spark, d), DEVICE, TOLERANCES)


@query(
    "evl9_framework_days",
    "SELECT household_id, tolerance, CAST(max(days) AS INT) AS framework FROM"
    " (SELECT household_id, agent, tolerance, coalesce(max(rn) FILTER (WHERE NOT coalesce("
    "    CASE WHEN agent = 'activity' THEN score > best * (1 - tolerance) ELSE score < tolerance END, false)), 0) + 1 AS days"
    "  FROM (SELECT *, row_number() OVER (PARTITION BY household_id, agent ORDER BY day) AS rn,"
    "         max(score) OVER (PARTITION BY household_id, agent) AS best FROM"
    "         (SELECT household_id, 'load_' || lower(replace(device, ' ', '_')) AS agent, day, distance AS score"
    "          FROM distances UNION ALL"
    "          SELECT household_id, 'activity', day, 1 - avg(abs(activity - p)) FROM p_activity"
    "          GROUP BY household_id, day))"
    f"  CROSS JOIN (SELECT unnest({TOLERANCES}::DOUBLE[]) AS tolerance) GROUP BY ALL)"
    " GROUP BY household_id, tolerance",
)
def evl9_framework_days(spark, d):
    """Load profiles and the hour-frequency model; the slowest agent decides."""
    from hearthgrid.functions.exprs import agent_key

    t = Prepared(spark, d)
    load_scores = t.distances().select(
        "household_id", F.concat(F.lit("load_"), agent_key(F.col("device"))).alias("agent"),
        "day", F.col("distance").alias("score"),
    )
    p = decide.activity_frequency(t.activity())
    truth = t.activity().select(
        "household_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "activity"
    )
    activity_scores = (
        p.join(truth, ["household_id", "day", "hour"])
        .groupBy("household_id", "day")
        .agg((1 - F.avg(F.abs(F.col("activity") - F.col("p")))).alias("score"))
        .withColumn("agent", F.lit("activity"))
    )
    scores = load_scores.unionByName(activity_scores)
    days = metrics.cold_start_days(
        scores, ["household_id", "agent"], TOLERANCES, F.col("agent") != "activity"
    )
    return metrics.framework_days(days, ["household_id"])


@query(
    "xai8_explanation_scores",
    "SELECT household_id, auc_true, fidelity, maee, msee, mse, accuracy, precision, recall FROM "
    + f"({_auc_sql('surrogates', 'household_id', 'label', 'surrogate', 'auc_true')}) JOIN "
    + f"({_auc_sql('surrogates', 'household_id', 'CAST(model > 0.5 AS INT)', 'CAST(surrogate > 0.5 AS INT)', 'fidelity')})"
    + f" USING (household_id) JOIN ({ERRORS_SQL}) USING (household_id) JOIN ({CONFUSION_SQL}) USING (household_id)",
)
def xai8_explanation_scores(spark, d):
    rows = stage(Prepared(spark, d).surrogates(), "surrogates")
    return rounded(
        metrics.explanation_scores(rows, ["household_id"], "label", "model", "surrogate")
    )
