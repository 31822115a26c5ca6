"""The whole workflow over stored tables: prepare, predict, recommend, evaluate.

Each step reads the tables of the step before and writes its own below one folder, so a
step can be run again alone and prepared data is shared by all of them (SRC-7, SNK-1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgrid.config import GRID_THRESHOLDS, WEATHER_COLUMNS, WEEKDAY_DUMMIES, EngineConfig
from hearthgrid.models import per_entity
from hearthgrid.operators import features, metrics, runs
from hearthgrid.plans import decide, prepare
from hearthgrid.sources.tables import read_table, write_table


class Workflow:
    """``root`` is the folder of the tables; households are dealt to hash buckets."""

    def __init__(self, spark: SparkSession, root: str, config: EngineConfig, model: str = "logit"):
        self.spark, self.root, self.config, self.model = spark, root.rstrip("/"), config, model

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.root}/{name}")

    def _write(self, name: str, df: DataFrame, key: str | None = "household_id") -> DataFrame:
        write_table(df, f"{self.root}/{name}", key)
        return self.table(name)

    def prepare(
        self, readings: DataFrame, prices: DataFrame, weather: DataFrame | None = None
    ) -> None:
        """Hourly readings, flags, feature frames, loads and runs."""
        c = self.config
        hourly = self._write("hourly", prepare.hourly_readings(readings, c.factor, c.fill))
        self._write("prices", prices, None)
        self._write(
            "activity",
            features.activity_flag(hourly, c.activity_threshold, list(c.active_appliances)),
        )
        self._write("usage", prepare.daily_usage(hourly, c))
        self._write("activity_features", prepare.activity_features(hourly, c, weather))
        self._write("usage_features", prepare.usage_features(hourly, c, weather))
        load = self._write("load", prepare.load_frame(hourly, c))
        self._write("runs", runs.runs(load))
        self._write("profiles", runs.load_profiles(load))

    def predict(self, **params) -> None:
        """Daily refitted probabilities of activity per hour and of usage per device and day."""
        frame = self.table("activity_features")
        weather = [w for w in WEATHER_COLUMNS if w in frame.columns]
        columns = ["hour", *[f"activity_lag_{k}" for k in self.config.activity_lags]]
        columns += [f"day_name_{d}" for d in WEEKDAY_DUMMIES] + weather
        self._write(
            "p_activity",
            per_entity.walk_forward(
                frame, ["household_id"], "ts", columns, "activity", self.model, **params
            ),
        )
        columns = ["usage_lag_1", "usage_lag_2", "active_last_2_days", *weather]
        self._write(
            "p_usage",
            per_entity.walk_forward(
                self.table("usage_features"), runs.DEVICE, "day", columns, "usage", self.model, **params
            ),
        )

    def _inputs(self) -> DataFrame:
        hours = self.table("p_activity").select(
            "household_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "p"
        )
        days = self.table("p_usage").select(*decide.KEY, "p")
        return decide.day_inputs(self.table("profiles"), self.table("prices"), hours, days)

    def recommend(self, activity_threshold: float, usage_threshold: float) -> DataFrame:
        """Recommendations of all days; days without one go to the table ``errors``."""
        inputs = self._inputs()
        self._write("errors", decide.input_errors(inputs))
        out = decide.recommend(decide.with_costs(inputs), activity_threshold, usage_threshold)
        return self._write("recommendations", out.select(*decide.RECOMMENDATION))

    def grid_search(
        self,
        activity_thresholds: tuple[float, ...] = GRID_THRESHOLDS,
        usage_thresholds: tuple[float, ...] = GRID_THRESHOLDS,
    ) -> DataFrame:
        """Summary per household and threshold pair; see also ``decide.optimal_thresholds``."""
        truth = decide.with_truth(
            decide.with_costs(self._inputs()),
            self.table("usage"), self.table("activity"), self.table("runs"),
        )
        return self._write("grid", decide.threshold_grid(truth, activity_thresholds, usage_thresholds))

    def agent_scores(self) -> DataFrame:
        """Scores of all agents in long form: ``household_id, agent, device, metric, value`` (EVL-10)."""
        none = F.lit(None).cast("string")
        activity = metrics.auc(self.table("p_activity"), ["household_id"], "label", "p").select(
            "household_id", F.lit("activity").alias("agent"), none.alias("device"),
            F.lit("auc").alias("metric"), F.col("auc").alias("value"),
        )
        usage = metrics.auc(self.table("p_usage"), runs.DEVICE, "label", "p").select(
            "household_id", F.lit("usage").alias("agent"), "device",
            F.lit("auc").alias("metric"), F.col("auc").alias("value"),
        )
        load = metrics.load_mse(self.table("runs"), self.table("profiles")).select(
            "household_id", F.lit("load").alias("agent"), "device",
            F.lit("mse").alias("metric"), F.col("mse").alias("value"),
        )
        return self._write("scores", activity.unionByName(usage).unionByName(load))
