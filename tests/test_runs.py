import random

import pytest
from conftest import at
from pyspark.sql import functions as F

from hearthgrid.operators import features, runs


def runs_reference(values):
    """Offsets of each run by scanning, as the definition says."""
    out = {}
    for i, v in enumerate(values):
        if v is None or v <= 0:
            continue
        if i == 0:
            out[0] = [v]
        elif values[i - 1] == 0:
            run = []
            for w in values[i : i + 24]:
                if w is None or w <= 0:
                    break
                run.append(w)
            out[i] = run
    return out


def profile_reference(values, first_hour, day):
    """Mean of the runs in the rows before ``day``, partial first day dropped."""
    start = 0 if first_hour % 24 == 0 else 24 - first_hour % 24
    prefix = [v for i, v in enumerate(values) if i >= start and (first_hour + i) // 24 < day]
    found = runs_reference(prefix).values()
    if not found:
        return [0.0] * 24
    return [sum(r[j] for r in found if j < len(r)) / len(found) for j in range(24)]


CASES = {
    "first row": [5, 6, 0, 0, 7, 0],
    "long run": [0] + [1] * 30 + [0],
    "after unknown": [0, None, 4, 5, 0, 3],
    "open end": [0, 0, 2, 3],
}


@pytest.mark.parametrize("name", CASES)
def test_runs_of_special_series(series, name):
    values = CASES[name]
    got = {
        int((r.start_ts - at(0)).total_seconds() // 3600): r.load[: r.run_hours]
        for r in runs.runs(series(values)).collect()
    }
    assert got == runs_reference([None if v is None else float(v) for v in values])


def test_first_run_can_be_kept_whole(series):
    row = runs.runs(series([5, 6, 0]), truncate_first_run=False).first()
    assert row.run_hours == 2 and row.load[:3] == [5, 6, 0]


def random_series(seed, n=24 * 6):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        out += [0] * rng.randint(0, 9) + [rng.randint(1, 9) for _ in range(rng.choice([0, 1, 3, 28]))]
        if rng.random() < 0.2:
            out.append(None)
    return [None if v is None else float(v) for v in out[:n]]


def test_profiles_match_a_loop_over_days(series, spark):
    cases = {h: (random_series(h), h % 3 * 7) for h in range(6)}
    frames = [series(v, first, household=h) for h, (v, first) in cases.items()]
    union = frames[0]
    for f in frames[1:]:
        union = union.unionByName(f)
    rows = runs.load_profiles(union).collect()
    assert rows
    for r in rows:
        values, first = cases[r.household_id]
        want = profile_reference(values, first, (r.day - at(0).date()).days)
        assert [r[h] for h in runs.HOURS] == pytest.approx(want), (r.household_id, r.day)


def test_partial_first_day_is_dropped(series):
    kept = runs.drop_partial_first_day(series([1] * 30, first_hour=5))
    assert kept.agg(F.min("ts")).first()[0] == at(24)
    assert runs.drop_partial_first_day(series([1] * 30)).count() == 30


def test_starts_need_an_off_hour_before(series):
    got = [r.ts for r in runs.starts(series([3, 0, 2, 2, None, 4])).orderBy("ts").collect()]
    assert got == [at(0), at(2)]


def periods_reference(values):
    out = []
    for i in range(len(values)):
        if i == 0 or values[i - 1] is None:
            out.append(None)
            continue
        shift = 1
        while i - shift >= 0 and values[i - shift] == 0:
            shift += 1
        out.append(shift)
    return out


def test_periods_since_last_use(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for key in range(20):
        values = [rng.choice([0, 0, 0, 1, None]) for _ in range(12)]
        if key == 0:
            values = [0] * 12
        want[key] = periods_reference(values)
        rows += [(key, i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k int, ts int, u int")
    out = features.add_periods_since(df, ["k"], ["u"]).orderBy("k", "ts").collect()
    for key in want:
        assert [r.periods_since_last_u for r in out if r.k == key] == want[key], key


def test_lags_and_last_two_days_treat_unknown_as_inactive(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 0, 0, 0])], "k int, ts int, activity int")
    out = features.add_lags(df, ["k"], ["activity"], (1, 2))
    got = out.withColumn("a", features.active_last_2_days()).orderBy("ts").collect()
    assert [r.a for r in got] == [0, 1, 1, 0]
    assert [r.activity_lag_2 for r in got] == [None, None, 1, 0]


def test_activity_ignores_other_appliances_but_keeps_the_hour(spark):
    df = spark.createDataFrame(
        [(1, "Fridge", at(0), 0.9), (1, "Kettle", at(0), None), (1, "Kettle", at(1), 0.5), (1, "Kettle", at(2), 0.51)],
        "household_id int, appliance string, ts timestamp_ntz, scaled double",
    )
    out = features.activity_flag(df, 0.5, ["Kettle"]).orderBy("ts").collect()
    assert [r.activity for r in out] == [0, 0, 1]
