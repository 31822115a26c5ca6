import random

import numpy as np
import pytest
from conftest import at
from pyspark.sql import functions as F

from hearthgrid.operators import clean, resample
from hearthgrid.operators.impute import knn_impute
from hearthgrid.operators.prefix import into_chunks, running_totals, weighted_quantiles
from hearthgrid.session import attach, stage

KEYS = ["household_id", "appliance"]


def readings(spark, values, step=1.0, household=1, appliance="Kettle"):
    rows = [
        (household, appliance, at(i * step), None if v is None else float(v))
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(
        rows, "household_id int, appliance string, ts timestamp_ntz, watts double"
    )


def column(df, name="watts", order="ts"):
    return [r[name] for r in df.orderBy(order).collect()]


def reference_truncate(values, factor=1.5):
    used = [v for v in values if v is not None and v != 0]
    if not used:
        return values
    q1, q3 = np.quantile(used, [0.25, 0.75])
    lo, hi = q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)
    cut = lambda v: v if v is None or v == 0 else float(int(hi)) if v > hi else float(int(lo)) if v < lo else v
    return [cut(v) for v in values]


def test_truncate_matches_definition_with_zeros_nulls_and_negative_bound(spark):
    values = [0, 0, 0, 0, 5, 6, 7, 8, 100, None, -90.5]
    got = column(clean.truncate_outliers(readings(spark, values), KEYS))
    assert got == reference_truncate([None if v is None else float(v) for v in values])


def test_truncate_random_values_and_all_zero_column(spark):
    rng = random.Random(1)
    values = [rng.choice([0.0, rng.uniform(1, 50), rng.uniform(500, 4000)]) for _ in range(300)]
    a = readings(spark, values)
    b = readings(spark, [0.0] * 5, appliance="Toaster")
    out = clean.truncate_outliers(a.unionByName(b), KEYS)
    assert column(out.where("appliance = 'Kettle'")) == pytest.approx(reference_truncate(values))
    assert column(out.where("appliance = 'Toaster'")) == [0.0] * 5


def test_quantiles_are_exact_for_any_chunking(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 200, 500).astype(float)
    df = spark.createDataFrame([(1, float(v)) for v in values], "k int, v double")
    counts = clean.value_counts(df, ["k"], "v")
    for chunks in (1, 6, 300):
        row = weighted_quantiles(
            counts, ["k"], "v", "n", {"a": 0.1, "b": 0.5, "c": 0.99}, chunks
        ).first()
        assert [row.a, row.b, row.c] == pytest.approx(np.quantile(values, [0.1, 0.5, 0.99]))


def test_running_totals_over_chunks(spark):
    df = spark.createDataFrame([(k, i, i * 2) for k in (1, None) for i in range(20)], "k int, o int, n int")
    out = running_totals(df, ["k"], "o", ["n"], 4)
    assert out.count() == 40
    for r in out.collect():
        assert r.n_before == sum(2 * i for i in range(r.o))
        assert r.n_total == 380


def test_minmax_constant_column_is_zero_and_null_stays(spark):
    a = readings(spark, [2, None, 6])
    b = readings(spark, [7, 7], appliance="Toaster")
    out = clean.scale_minmax(a.unionByName(b), KEYS)
    assert column(out.where("appliance = 'Kettle'"), "scaled") == [0.0, None, 1.0]
    assert column(out.where("appliance = 'Toaster'"), "scaled") == [0.0, 0.0]


def test_backfill_keeps_trailing_nulls(spark):
    out = clean.backfill(readings(spark, [None, 3, None, 4, None]), KEYS, ["watts"])
    assert column(out) == [3, 3, 4, 4, None]


def test_forward_fill_carries_across_days_and_zeroes_long_gaps(spark):
    # readings every 12 hours, so every second one opens a new day
    values = [None, 10, None, None, 20, 5000, None]
    out = clean.forward_fill(readings(spark, values, step=12), KEYS, max_gap_seconds=13 * 3600)
    assert column(out) == [None, 10, 10, 0.0, 20, 0.0]


def test_resample_fills_the_grid(spark):
    df = readings(spark, [10, 20, None, None, None, 50], step=0.5)
    late = readings(spark, [1.0], appliance="Toaster")
    both = df.unionByName(late)
    out = resample.resample_mean(both, KEYS, ["watts"], "hour", ["household_id"])
    assert column(out.where("appliance = 'Kettle'")) == [15, None, 50]
    assert column(out.where("appliance = 'Toaster'")) == [1, None, None]
    zero = resample.resample_mean(both, KEYS, ["watts"], "hour", ["household_id"], "zero")
    assert column(zero.where("appliance = 'Toaster'")) == [1, 0, 0]
    with pytest.raises(ValueError):
        resample.resample_mean(df, KEYS, ["watts"], fill="mean")


def test_day_counts_include_empty_days(spark):
    df = readings(spark, [1, 1, 1], step=30)
    counts = {r.day.day: r.n_rows for r in resample.day_counts(df, ["household_id"]).collect()}
    assert counts == {1: 1, 2: 1, 3: 1}
    sparse = readings(spark, [1, 1], step=72)
    counts = {r.day.day: r.n_rows for r in resample.day_counts(sparse, ["household_id"]).collect()}
    assert counts == {1: 1, 2: 0, 3: 0, 4: 1}


def test_attach_broadcasts_by_bytes(spark):
    fact = readings(spark, range(100)).unionByName(readings(spark, range(50), household=2))
    dim = stage(spark.createDataFrame([(1, "a"), (2, "b")], "household_id int, x string"))
    key = lambda df: sorted((r.household_id, r.ts, r.x) for r in df.collect())
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    small = attach(fact, dim, ["household_id"])
    assert "BroadcastHashJoin" in plan(small)
    rows, limit = key(small), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16b")
    try:
        large = attach(fact, dim, ["household_id"])
        assert "SortMergeJoin" in plan(large) and key(large) == rows and len(rows) == 150
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_crowded_values_are_cut_evenly(spark):
    """All values in [0, 1): the ranges follow the values, and the result stays exact."""
    rng = np.random.default_rng(5)
    values = rng.random(20_000) ** 4
    df = spark.createDataFrame([(1, float(v)) for v in values], "k int, v double")
    counts = clean.value_counts(df, ["k"], "v")
    sizes = [r["count"] for r in into_chunks(counts, ["k"], "v", 64).groupBy("_chunk").count().collect()]
    assert len(sizes) == 64 and max(sizes) < 2 * len(values) / 64
    row = weighted_quantiles(counts, ["k"], "v", "n", {"q": 0.3}, 64).first()
    assert row.q == pytest.approx(np.quantile(values, 0.3), abs=1e-15)


def impute_reference(rows, k):
    rows = np.array(rows, dtype=float)
    out = rows.copy()
    for i, a in enumerate(rows):
        for j in np.flatnonzero(np.isnan(a)):
            near = []
            for n, b in enumerate(rows):
                both = ~np.isnan(a) & ~np.isnan(b)
                if not np.isnan(b[j]) and both.any():
                    near.append((np.sqrt(len(a) / both.sum() * ((a - b)[both] ** 2).sum()), n, b[j]))
            near = sorted(near)[:k]
            if not near:
                out[i, j] = np.nanmean(rows[:, j])
            elif near[0][0] == 0:
                out[i, j] = np.mean([v for d, _, v in near if d == 0])
            else:
                out[i, j] = sum(v / d for d, _, v in near) / sum(1 / d for d, _, v in near)
    return out


def test_knn_impute_matches_definition_in_one_or_many_buckets(spark):
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 6, (40, 3)).astype(float)
    rows[rng.random((40, 3)) < 0.2] = np.nan
    rows[7] = np.nan  # nothing to compare: column means
    data = [(at(i), *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "ts timestamp_ntz, a double, b double, c double")
    want = impute_reference(rows, 3)
    for bucket in (100, 9, 2):
        out = knn_impute(df, "ts", ["a", "b", "c"], k=3, bucket=bucket).orderBy("ts").collect()
        assert np.array([[r.a, r.b, r.c] for r in out]) == pytest.approx(want)


def test_knn_impute_compares_few_pairs(spark):
    """At ten times the rows the distances grow far less than gaps times donors."""
    counts = {}
    for n in (400, 4000):
        rng = np.random.default_rng(n)
        rows = np.column_stack([rng.uniform(0, 360, n), rng.normal(10, 8, n), rng.uniform(0, 20, n), rng.normal(0, 3, n)])
        for j in range(1, 4):
            rows[rng.random(n) < 0.1, j] = np.nan
        df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(rows)], "i long, a double, b double, c double, d double")
        counter = spark.sparkContext.accumulator(0)
        out = knn_impute(df, "i", ["a", "b", "c", "d"], counter=counter).orderBy("i").collect()
        gaps = np.isnan(rows).any(axis=1).sum()
        counts[n] = counter.value / (gaps * n)
        if n == 400:
            assert np.array([[r.a, r.b, r.c, r.d] for r in out]) == pytest.approx(impute_reference(rows, 7))
    print("share of all pairs compared:", counts)
    assert counts[4000] < 0.25 and counts[4000] < counts[400] / 2


def test_knn_impute_odd_tables(spark):
    schema = "i long, a double, b double"
    assert knn_impute(spark.createDataFrame([], schema), "i", ["a", "b"]).count() == 0
    out = knn_impute(spark.createDataFrame([(1, None, None), (2, None, 3.0)], schema), "i", ["a", "b"]).orderBy("i").collect()
    assert [(r.a, r.b) for r in out] == [(None, 3.0), (None, 3.0)]
    equal = spark.createDataFrame([(i, 1.0, None if i % 3 == 0 else float(i)) for i in range(90)], schema)
    got = knn_impute(equal, "i", ["a", "b"], k=2, bucket=8).where("i = 30").first()
    assert got.b == 1.5  # at distance zero all that are kept decide: ids 1 and 2


def test_drop_all_null_columns(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, None)], "a int, b double, c double")
    assert clean.drop_all_null_columns(df).columns == ["a", "c"]
