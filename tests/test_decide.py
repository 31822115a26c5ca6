import re
from datetime import date

import pytest
from conftest import at
from pyspark.sql import functions as F

from hearthgrid.operators.prices import price_vectors, replicate_years
from hearthgrid.operators.runs import HOURS
from hearthgrid.plans import decide

DAY = date(2024, 1, 1)
FLAT = [1.0] * 24


def prices(spark, values, skip=()):
    rows = [(at(i), float(v)) for i, v in enumerate(values) if i not in skip]
    return spark.createDataFrame(rows, "ts timestamp_ntz, price double")


def profiles(spark, load):
    load = list(load) + [0.0] * (24 - len(load))
    schema = "household_id int, device string, day date, n_runs long, " + ", ".join(f"{h} double" for h in HOURS)
    return spark.createDataFrame([(1, "Dishwasher", DAY, 1, *map(float, load))], schema)


def inputs(spark, load, price, p=FLAT, use=1.0, skip=()):
    active = spark.createDataFrame(
        [(1, DAY, h, None if v is None else float(v)) for h, v in enumerate(p)],
        "household_id int, day date, hour int, p double",
    )
    usage = spark.createDataFrame(
        [(1, "Dishwasher", DAY, use)], "household_id int, device string, day date, p double"
    )
    return decide.day_inputs(profiles(spark, load), prices(spark, price, skip), active, usage)


def recommend(spark, *args, thr=0.5, use_thr=0.5, **kw):
    return decide.recommend(decide.with_costs(inputs(spark, *args, **kw)), thr, use_thr).first()


RISING = list(range(48))


def test_costs_and_cheapest_hour(spark):
    price = RISING[::-1]
    row = decide.with_costs(inputs(spark, [2, 1], price)).first()
    assert row.costs == [2.0 * price[s] + price[s + 1] for s in range(24)]
    assert recommend(spark, [2, 1], price).recommendation == 23


def test_threshold_is_inclusive_and_ties_take_the_first_hour(spark):
    p = [0.0] * 24
    p[7] = p[9] = 0.5
    assert recommend(spark, [1], [3] * 48, p=p).recommendation == 7


def test_no_likely_hour_and_unlikely_use(spark):
    row = recommend(spark, [1], RISING, p=[0.4] * 24)
    assert (row.best_launch_hour, row.no_recommend_flag_activity, row.recommendation) == (0, 1, None)
    row = recommend(spark, [1], RISING, use=0.4)
    assert (row.best_launch_hour, row.no_recommend_flag_usage, row.recommendation) == (0, 1, None)
    assert recommend(spark, [1], RISING, use=0.5).recommendation == 0


def test_unlikely_hours_never_win(spark):
    # a negative price in an unlikely hour, and an all-zero profile
    p = [0.0, 0.0, 0.9] + [0.9] * 21
    price = [-5] + [2] * 47
    assert recommend(spark, [1], price, p=p).recommendation == 2
    assert recommend(spark, [0], price, p=p).recommendation == 2


def test_missing_inputs_become_error_rows(spark):
    got = lambda **kw: [r.reason for r in decide.input_errors(inputs(spark, [1], RISING, **kw)).collect()]
    assert got(skip=(30,)) == ["missing prices"]
    assert got(p=[None] + FLAT[1:]) == ["missing activity probability"]
    assert got(use=None) == ["missing usage probability"]
    assert got() == []


def evaluated(spark, price, starts, rec, used=1, active=FLAT):
    struct = "array<struct<hour:int,load:array<double>>>"
    day_runs = [(h, [float(x) for x in load] + [0.0] * (24 - len(load))) for h, load in starts] or None
    df = spark.createDataFrame(
        [(1, "Dishwasher", DAY, rec, [float(p) for p in price], used, [int(a) for a in active], day_runs)],
        "household_id int, device string, day date, recommendation int, prices array<double>,"
        f" usage_true int, activity_true array<int>, starts {struct}",
    )
    return decide.evaluate(df).first()


def test_nearest_start_ties_and_missing(spark):
    runs_of_day = [(4, [1]), (8, [2]), (20, [3])]
    assert evaluated(spark, RISING, runs_of_day, 6).relevant_start == 4
    assert evaluated(spark, RISING, runs_of_day, 7).relevant_start == 8
    assert evaluated(spark, RISING, runs_of_day, None).relevant_start == 4
    none = evaluated(spark, RISING, [], 6)
    assert none.relevant_start is None and none.cost_no_recommendation is None
    assert none.cost_recommendation == 0 and none.savings is None


def test_savings_of_a_moved_run(spark):
    row = evaluated(spark, RISING, [(10, [2, 1])], 3)
    assert row.cost_no_recommendation == 2 * 10 + 11
    assert row.cost_recommendation == 2 * 3 + 4
    assert row.savings == 21 and row.relative_savings == pytest.approx(21 / 31)
    assert row.acceptable == 1
    assert evaluated(spark, RISING, [(10, [1])], 3, active=[0] * 24).acceptable == 0
    assert evaluated(spark, [0] * 48, [(10, [1])], 3).relative_savings is None


def test_grid_equals_one_evaluation_per_pair(spark):
    p = [0.1 * (h % 10) for h in range(24)]
    costed = decide.with_costs(inputs(spark, [2, 1], [((i * 7) % 13) - 3 for i in range(48)], p=p, use=0.3))
    usage = spark.createDataFrame([(1, "Dishwasher", DAY, 1)], "household_id int, device string, day date, usage int")
    activity = spark.createDataFrame([(1, at(h), h % 2) for h in range(24)], "household_id int, ts timestamp_ntz, activity int")
    load = [0.0] * 24
    load[0] = 4.0
    run_table = spark.createDataFrame(
        [(1, "Dishwasher", at(5), load), (1, "Dishwasher", at(15), load)],
        "household_id int, device string, start_ts timestamp_ntz, load array<double>",
    )
    truth = decide.with_truth(costed, usage, activity, run_table)
    thr = (0.2, 0.5, 0.95)
    grid = decide.threshold_grid(truth, thr, thr)
    rows = {(r.activity_threshold, r.usage_threshold): r for r in grid.collect()}
    assert len(rows) == 9
    for (a, u), r in rows.items():
        one = decide.summarise(decide.evaluate(decide.recommend(truth, a, u)), ["household_id"]).first()
        for c in decide.SUMMARY:
            assert r[c] == (pytest.approx(one[c]) if one[c] is not None else None), (a, u, c)


def test_optimal_pair_takes_the_last_of_ties(spark):
    cols = "household_id int, activity_threshold double, usage_threshold double, n_recommendations long, acceptable double, total_savings double, relative_savings_mean double, relative_savings_median double"
    grid = spark.createDataFrame(
        [(1, 0.125, 0.5, 1, 1.0, 9.0, 0.1, 0.1), (1, 0.25, 0.125, 2, 1.0, 9.0, 0.1, 0.1),
         (1, 0.5, 0.5, 3, 1.0, None, 0.1, 0.1), (1, 0.75, 0.5, 4, 1.0, -1.0, 0.1, 0.1)], cols)
    row = decide.optimal_thresholds(grid).first()
    assert row.threshold_key == "activity: 0.25; usage: 0.125"
    wide = decide.sensitivity(grid, "total_savings", (0.125, 0.5)).orderBy("activity_threshold").collect()
    assert [(r.usage_0_125, r.usage_0_5) for r in wide] == [(None, 9.0), (9.0, None), (None, None), (None, -1.0)]
    with pytest.raises(ValueError):
        decide.sensitivity(grid, "nothing")


def test_message_text(spark):
    out = decide.recommend(decide.with_costs(inputs(spark, [1], [2] * 5 + [1] + [2] * 42)), 0.5, 0.5)
    row = decide.messages(out).first()
    assert row.message == (
        "You have a recommendation for the following device: Dishwasher\n\nPlease use the device on the "
        "01.01.2024 at 05:00 o'clock because it saves you 48.94 % of costs compared to the mean of the day.\n"
    )


def test_price_days_need_48_hours(spark):
    days = [r.day for r in price_vectors(prices(spark, range(96), skip=(50,))).collect()]
    assert days == [date(2024, 1, 1)] or days == []
    days = {r.day: r.prices for r in price_vectors(prices(spark, range(72))).collect()}
    assert set(days) == {date(2024, 1, 1), date(2024, 1, 2)}
    assert days[date(2024, 1, 2)] == [float(i) for i in range(24, 72)]


def test_replicated_years_skip_leap_day(spark):
    hours = [(at(24 * d + 5), 1.0) for d in range(366)]
    rows = spark.createDataFrame(hours, "ts timestamp_ntz, price double")
    out = replicate_years(rows, 2024, [2022, 2023])
    years = {r.y: r["count"] for r in out.groupBy(F.year("ts").alias("y")).count().collect()}
    assert years == {2022: 365, 2023: 365, 2024: 366}
    assert out.where(F.hour("ts") != 5).count() == 0


def test_threshold_grid_joins_without_exchange(spark):
    """Branches of the hourly table lie by household: without any broadcast, rows move for the prices of a day and the final sum only."""
    from hearthgrid.catalog.decisions import Prepared

    def shuffles():
        plan = Prepared(spark, "/root/testdata/sf0.001").grid()._jdf.queryExecution().executedPlan().toString()
        return re.findall(r"Exchange (?:hash|range)partitioning\((.*?), 4\)", plan)

    assert len(shuffles()) <= 3
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = [re.sub(r"#\d+L?", "", k) for k in shuffles()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [k for k in keys if k != "day"] == ["household_id, activity_threshold"]
