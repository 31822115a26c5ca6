import json

import pytest
from conftest import at
from pyspark.sql import functions as F

from hearthgrid.operators import sentences
from hearthgrid.plans.dates import date_bounds, timespan
from hearthgrid.sources import meter, tables

README = """TEXT with House prices and 1. numbers

House 1
0.Aggregate, 1.Fridge, 2.Washing Machine (1), 3.Tumble Dryer,
4.Hi-Fi, 5.MJY Computer
\t!NOTES
\t\t0. October 2014, lamps changed
\t\t5.a Desktop

House 12
0.Aggregate, 1.Kettle
\t!NOTES
"""


def test_labels_are_read_per_house_and_notes_are_skipped(spark, tmp_path):
    (tmp_path / "readme.txt").write_text(README)
    rows = meter.read_appliance_labels(spark, str(tmp_path / "readme.txt")).collect()
    got = {(r.household_id, r.slot): r.appliance for r in rows}
    assert got == {
        (1, 0): "Aggregate", (1, 1): "Fridge", (1, 2): "Washing Machine (1)", (1, 3): "Tumble Dryer",
        (1, 4): "Hi-Fi", (1, 5): "MJY Computer", (12, 0): "Aggregate", (12, 1): "Kettle",
    }


def test_meter_files_of_all_houses_in_one_scan(spark, tmp_path):
    head = ",".join(["Time", "Unix", *meter.SLOTS])
    line = lambda t, v: f"{t},0,{v}," + ",".join(["NaN"] + [str(v)] * 8)
    for house, v in ((1, 5), (12, 7)):
        (tmp_path / f"CLEAN_House{house}.csv").write_text(
            "\n".join([head, line("2013-10-09 13:06:17", v), line("2013-10-09 13:06:31", v + 1)])
        )
    (tmp_path / "readme.txt").write_text(README)
    rows = meter.read_readings(spark, str(tmp_path / "*.csv"), str(tmp_path / "readme.txt")).collect()
    got = {(r.household_id, r.appliance, r.ts.second): r.watts for r in rows}
    assert got[1, "Aggregate", 17] == 5 and got[1, "Washing Machine (1)", 31] == 6
    assert got[12, "Aggregate", 31] == 8
    assert (12, "Kettle", 17) not in got and (1, "Fridge", 17) not in got  # NaN is no reading


def test_prices_are_read_day_first(spark, tmp_path):
    (tmp_path / "p.csv").write_text('MTU (UTC),price\n"02.01.2015 00:00 - 02.01.2015 01:00",31.5\n')
    row = tables.read_prices_csv(spark, str(tmp_path / "p.csv")).first()
    assert (row.ts.month, row.ts.day, row.price) == (1, 2, 31.5)


def test_configs_give_the_device_legend(spark, tmp_path):
    for house, devices in ((3, ["Tumble Dryer", "Dishwasher"]), (10, ["Washing Machine"])):
        doc = {"data": {"household": house, "start_dates": {"load": "2013-09-26"}},
               "user_input": {"shiftable_devices": devices, "threshold": 0.01}, "other": {"x": 1}}
        (tmp_path / f"{house}_config.json").write_text(json.dumps(doc, indent=2))
    configs = tables.read_configs(spark, str(tmp_path / "*config.json"))
    rows = tables.device_legend(configs, 2).orderBy("household").collect()
    assert [tuple(r) for r in rows] == [(3, "Tumble Dryer", "Dishwasher"), (10, "Washing Machine", None)]
    assert configs.where("data.household = 3").first().data.start_dates == {"load": "2013-09-26"}
    with pytest.raises(Exception, match="only 1 positions"):
        tables.device_legend(configs, 1).collect()


def test_score_rows_are_appended(spark, tmp_path):
    path = str(tmp_path / "scores")
    for v in (0.1, 0.2):
        tables.append_scores(tables.score_rows(spark, [("logit", {"max_iter": 10}, "auc", v)]), path)
    rows = tables.read_table(spark, path).orderBy("value").collect()
    assert [(r.model, r.params, r.value) for r in rows] == [("logit", {"max_iter": "10"}, v) for v in (0.1, 0.2)]


def test_weather_csv_and_timespan_include_both_ends(spark, tmp_path):
    (tmp_path / "w.csv").write_text("ts,temp,dwpt,rhum,wdir,wspd\n" + "".join(
        f"2024-01-01T{h:02d}:00:00,{h},NaN,,1,2\n" for h in range(5)))
    w = tables.read_weather(spark, str(tmp_path / "w.csv"), "csv")
    assert [r.temp for r in timespan(w, "2024-01-01 01:00:00", hours=2).orderBy("ts").collect()] == [1, 2, 3]
    assert w.where("dwpt IS NOT NULL OR rhum IS NOT NULL").count() == 0


def test_date_bounds(spark):
    df = spark.createDataFrame([(1, at(5)), (1, at(100))], "household_id int, ts timestamp_ntz")
    row = date_bounds(df).first()
    assert (row.first_date.day, row.last_date.day) == (2, 4)


def attributions(spark, rows):
    return spark.createDataFrame(
        [(1, f, None if v is None else float(v), float(a), None if u is None else float(u)) for f, v, a, u in rows],
        "i int, feature string, value double, attribution double, unscaled double",
    )


LAGS = [("activity_lag_24", 0, -0.1, None), ("activity_lag_48", 1, 0.3, None), ("activity_lag_72", 0, 0.2, None)]


@pytest.mark.parametrize(
    "rows, sentence",
    [
        (
            LAGS + [("temp", 0.2, 0.1, 11.119), ("dwpt", 0.4, -0.1, 5), ("wspd", 0.1, 0.2, 3), ("hour", 5, 0.1, None),
                    ("day_name_Monday", 1, 0.0, None), ("day_name_Sunday", 0, -0.3, None)],
            sentences.OPENING + "We believe you are active today since you were active during the last two days."
            "The weather conditions (windspeed:3.0, temperature:11.12) support that recommendation."
            "The weekday and hour strenghtens that prediction.",
        ),
        (
            [(f, 0, -1, None) for f, *_ in LAGS] + [("temp", 0.2, -0.1, 11), ("hour", 5, 0.1, None),
                                                    ("day_name_Monday", 1, -0.1, None)],
            sentences.OPENING + "The hour strenghtens that prediction.",
        ),
        (
            [(f, 0, 0.1, None) for f, *_ in LAGS] + [("rhum", 0.2, 0.0, 80)],
            sentences.OPENING + "We believe you are active today since you were not active during the last day."
            "The weather condition (relative humidity:80.0) support that recommendation.",
        ),
    ],
)
def test_activity_sentences(spark, rows, sentence):
    assert sentences.activity_sentences(attributions(spark, rows), ["i"]).first().sentence == sentence


def test_usage_sentence(spark):
    rows = [("usage_lag_1", 0, 0.1, None), ("usage_lag_2", 1, 0.4, None), ("active_last_2_days", 0, 0.1, None)]
    assert sentences.usage_sentences(attributions(spark, rows), ["i"]).first().sentence == (
        "We believe you are likely to use the device in the near future since you were not active during the "
        "last 2 days and have used the device in the last two days."
    )


def test_a_slot_without_a_label_keeps_its_name(spark):
    long = spark.createDataFrame([(1, "Aggregate", 1.0), (1, "Appliance1", 2.0), (2, "Appliance1", 3.0)], "household_id int, slot string, watts double")
    labels = spark.createDataFrame([(1, 1, "Kettle")], "household_id int, slot int, appliance string")
    got = meter.label_slots(long.withColumn("ts", F.lit(None).cast("timestamp_ntz")), labels).collect()
    assert sorted((r.household_id, r.appliance, r.watts) for r in got) == [(1, "Aggregate", 1.0), (1, "Kettle", 2.0), (2, "Appliance1", 3.0)]


def test_tables_are_written_by_size_and_bucket(spark, tmp_path):
    import glob

    path = str(tmp_path / "t")
    files = lambda: glob.glob(f"{path}/_bucket=*/*.parquet")
    rows = spark.range(20_000).select((F.col("id") % 5).cast("int").alias("household_id"), "id", F.rand(1).alias("x"))
    tables.write_table(rows, path, "household_id", buckets=4)
    folders = {f.split("/")[-2] for f in files()}
    assert len(files()) == len(folders) <= 4
    tables.write_table(rows, path, "household_id", buckets=4, file_bytes=20_000)
    assert len(files()) > 8 and tables.read_table(spark, path).count() == 20_000
    # a second write of one household's bucket leaves the others
    other = rows.where("household_id = 3").withColumn("x", F.lit(-1.0))
    tables.write_table(other, path, "household_id", buckets=4)
    got = tables.read_table(spark, path)
    own = {r.b for r in rows.select("household_id", F.pmod(F.xxhash64("household_id"), F.lit(4)).alias("b")).where("household_id = 3").distinct().collect()}
    left = rows.where(~F.pmod(F.xxhash64("household_id"), F.lit(4)).isin(*own)).count()
    assert got.where("x = -1").count() == 4000 and got.where("x >= 0").count() == left
    tables.write_table(rows.limit(0), path, "household_id", buckets=4)
    assert tables.read_table(spark, path).count() == 4000 + left
