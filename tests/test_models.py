import numpy as np
import pytest
from conftest import at
from pyspark.sql import functions as F

from hearthgrid.models import per_entity, pooled, splits
from hearthgrid.operators import explain
from hearthgrid.operators.metrics import auc

COLS = ["a", "b"]


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        a, b = rng.normal(size=2)
        rows.append((i % 4, at(i // 4), float(a), float(b), int(2 * a - b + 0.3 * rng.normal() > 0)))
    return spark.createDataFrame(
        rows, "household_id int, ts timestamp_ntz, a double, b double, y int"
    ).cache()


@pytest.mark.parametrize(
    "name, params",
    [
        ("logit", {}),
        ("random forest", {"n_estimators": 10, "max_depth": 4}),
        ("xgboost", {"n_estimators": 5, "max_depth": 3}),
        ("ada", {"n_estimators": 12, "learning_rate": 1.0}),
        ("ebm", {"bins": 8}),
    ],
)
def test_models_separate_the_classes(separable, name, params):
    scored = pooled.fit(name, separable, COLS, "y", **params).score(separable)
    assert auc(scored, [], "y", "p").first().auc > 0.9
    lo, hi = scored.agg(F.min("p"), F.max("p")).first()
    assert 0 <= lo < hi <= 1


def test_unknown_model_names_fail(separable):
    with pytest.raises(ValueError):
        pooled.fit("tree of life", separable, COLS, "y")
    with pytest.raises(ValueError):
        per_entity.walk_forward(separable, ["household_id"], "ts", COLS, "y", "tree of life")
    with pytest.raises(ValueError):
        per_entity.cold_start(separable, ["household_id"], "ts", COLS, "y", "tree of life")


def test_pooled_and_numpy_logistic_agree(separable):
    model = pooled.fit("logit", separable, COLS, "y").model.stages[-1]
    rows = separable.toPandas()
    w = per_entity.fit_logistic(rows[COLS].to_numpy(), rows["y"].to_numpy(float))
    assert [model.intercept, *model.coefficients] == pytest.approx(w, abs=1e-3)


def test_knn_with_one_neighbour_returns_labels_and_breaks_ties_by_time():
    x, y = np.array([[0.0], [1.0], [1.0], [5.0]]), np.array([1.0, 0.0, 1.0, 0.0])
    assert list(per_entity.predict_knn(x, y, np.array([[0.0], [1.0], [5.0]]), 1)) == [1, 0, 0]
    assert per_entity.predict_knn(x, y, np.array([[1.0]]), 10)[0] == 0.5


@pytest.mark.parametrize("leak_free", [True, False])
def test_walk_forward_uses_the_past_only(spark, leak_free):
    rows = [(1, at(h), float(h % 2), h % 2) for h in range(24 * 4)]
    rows[70] = (1, at(70), None, 0)
    df = spark.createDataFrame(rows, "household_id int, ts timestamp_ntz, x double, y int")
    out = per_entity.walk_forward(df, ["household_id"], "ts", ["x"], "y", "knn", leak_free, n_neighbors=1)
    got = out.orderBy("ts").collect()
    first_day = [r for r in got if r.ts < at(24)]
    if leak_free:
        assert all(r.p is None and "two classes" in r.reason for r in first_day)
    else:
        assert [r.p for r in first_day] == [r.label for r in first_day]
    later = [r for r in got if r.ts >= at(24)]
    assert [r.reason for r in later if r.p is None] == ["missing features"]
    assert all(r.p == r.label for r in later if r.p is not None)


def test_walk_forward_logit_scores_training_days(separable):
    out = per_entity.walk_forward(separable, ["household_id"], "ts", COLS, "y")
    scores = per_entity.mean_train_auc(out, ["household_id"], "ts").collect()
    assert len(scores) == 4 and all(r.auc_train > 0.9 for r in scores)
    assert auc(out, [], "label", "p").first().auc > 0.85


def test_splits_differ_by_the_test_day(spark):
    df = spark.createDataFrame([(1, at(24 * d), d % 2) for d in range(10)], "household_id int, ts timestamp_ntz, u int")
    df = df.withColumn("day", F.to_date("ts"))
    train, test = splits.usage_split(df, "2024-01-05")
    leaky, _ = splits.usage_split(df, "2024-01-05", leak_free=False)
    assert (train.count(), leaky.count(), test.count()) == (4, 5, 1)
    assert leaky.exceptAll(train).collect() == test.collect()
    train, test = splits.activity_split(df, "2024-01-05", "2024-01-03")
    assert (train.count(), test.count()) == (2, 1)


def test_pooled_walk_forward_reports_unfit_folds(separable):
    rows = separable.withColumn("day", F.to_date("ts"))
    folds = [("2024-01-01", "2024-01-01"), ("2024-01-03", "2024-01-05")]
    scored, train_auc, errors = pooled.walk_forward(rows, folds, "day", COLS, "y", "logit")
    assert [e[0] for e in errors] == ["2024-01-01"]
    assert [f for f, _ in train_auc] == ["2024-01-03"] and train_auc[0][1] > 0.9
    assert scored.where("day < '2024-01-03'").count() == 0


# --- explanations ---


def linear(df):
    return df.withColumn("p", 0.3 * F.col("a") - 0.2 * F.col("b") + 0 * F.col("c"))


def product(df):
    return df.withColumn("p", F.col("a") * F.col("b") + 0 * F.col("c"))


@pytest.fixture(scope="module")
def instances(spark):
    return spark.createDataFrame(
        [(1, 1.0, 2.0, 3.0), (2, -1.0, 0.5, 0.0)], "i int, a double, b double, c double"
    )


BACKGROUND = [
    {"w": 0.25, "a": 0.0, "b": 1.0, "c": 2.0},
    {"w": 0.75, "a": 2.0, "b": -1.0, "c": 5.0},
]


def phi(df):
    return {(r.i, r.feature): r.attribution for r in df.collect()}


def test_shapley_of_a_linear_score_is_the_closed_form(instances):
    got = phi(explain.shapley(instances, ["i"], ["a", "b", "c"], BACKGROUND, linear))
    mean_a, mean_b = 0.25 * 0 + 0.75 * 2, 0.25 * 1 - 0.75
    assert got[1, "a"] == pytest.approx(0.3 * (1 - mean_a))
    assert got[1, "b"] == pytest.approx(-0.2 * (2 - mean_b))
    assert got[2, "c"] == pytest.approx(0)


@pytest.mark.parametrize("method", ["exact", "permutation"])
def test_shapley_adds_up_and_is_symmetric(instances, method):
    rows = explain.shapley(
        instances, ["i"], ["a", "b", "c"], BACKGROUND, product, method, permutations=6
    ).collect()
    for i in (1, 2):
        mine = [r for r in rows if r.i == i]
        assert sum(r.attribution for r in mine) == pytest.approx(mine[0].prediction - mine[0].base)
        assert [r.attribution for r in mine if r.feature == "c"] == [pytest.approx(0)]
    same = [{"w": 1.0, "a": 0.0, "b": 0.0, "c": 0.0}]
    got = phi(explain.shapley(instances, ["i"], ["a", "b", "c"], same, product, permutations=6))
    assert got[1, "a"] == pytest.approx(got[1, "b"]) == pytest.approx(1.0)


def test_backgrounds_are_weighted_and_limited(separable):
    rows = explain.sample_background(separable, COLS, 15)
    assert len(rows) == 15 and sum(r["w"] for r in rows) == pytest.approx(1)
    assert rows == explain.sample_background(separable.repartition(7), COLS, 15)
    centres = explain.kmeans_background(separable, COLS, 4)
    assert len(centres) == 4 and sum(r["w"] for r in centres) == pytest.approx(1)
    assert len(explain.sample_background(separable, COLS, 150)) == min(150, separable.na.drop(subset=COLS).count())


def test_lime_recovers_a_linear_score(instances):
    scales = {"a": (0.0, 1.0), "b": (0.0, 2.0), "c": (0.0, 0.0)}
    out = explain.lime(instances, ["i"], ["a", "b", "c"], scales, linear, samples=400, alpha=1e-9)
    got = {(r.i, r.feature): r for r in out.collect()}
    assert got[1, "a"].weight == pytest.approx(0.3, abs=1e-6)
    assert got[2, "b"].weight == pytest.approx(-0.2, abs=1e-6)
    assert got[1, "a"].local_pred == pytest.approx(0.3 - 0.4, abs=1e-6)
    again = explain.lime(instances.repartition(5), ["i"], ["a", "b", "c"], scales, linear, samples=400, alpha=1e-9)
    assert {(r.i, r.feature): r.weight for r in again.collect()} == pytest.approx(
        {k: r.weight for k, r in got.items()}
    )
    top = explain.ranked_weights(out, ["i"]).where("rank = 1").collect()
    assert {r.i: r.feature for r in top} == {1: "a", 2: "a"}


def test_linear_attributions_use_group_means(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (2, 3, 9.0)], "k int, i int, x double")
    got = {r.i: r.attribution for r in explain.linear_attributions(df, ["k", "i"], ["k"], {"x": 0.5}).collect()}
    assert got == {1: -0.5, 2: 0.5, 3: 0.0}


def test_additive_contributions_sum_to_the_log_odds(separable):
    model = pooled.fit("ebm", separable, COLS, "y", bins=6)
    parts = model.contributions(separable, ["household_id", "ts"])
    total = parts.groupBy("household_id", "ts").agg(F.sum("contribution").alias("s"))
    raw = model.score(separable).select("household_id", "ts", F.log(F.col("p") / (1 - F.col("p"))).alias("raw"))
    worst = total.join(raw, ["household_id", "ts"]).agg(
        F.max(F.abs(F.col("s") + model.shapes.intercept - F.col("raw")))
    ).first()[0]
    assert worst < 1e-9
    shapes = pooled.shape_table(model)
    assert {r.feature for r in shapes.select("feature").distinct().collect()} == {"a", "b", "a x b"}


@pytest.mark.parametrize("method", ["exact", "permutation"])
def test_shapley_of_nine_features_and_many_background_rows(spark, method):
    columns = [f"f{j}" for j in range(9)]
    one = spark.createDataFrame([(1, *map(float, range(1, 10)))], "i int, " + ", ".join(f"{c} double" for c in columns))
    background = [{"w": 1 / 120, **{c: float((k * (j + 1)) % 5) for j, c in enumerate(columns)}} for k in range(120)]
    score = lambda df: df.withColumn("p", sum((F.col(c) * (j + 1) for j, c in enumerate(columns)), F.lit(0.0)))
    got = phi(explain.shapley(one, ["i"], columns, background, score, method, permutations=4))
    for j, c in enumerate(columns):
        assert got[1, c] == pytest.approx((j + 1) * (j + 1 - sum(b[c] for b in background) / 120))
    with pytest.raises(ValueError):
        explain.shapley(one, ["i"], columns, background, score, "auto")


def test_kernel_shapley_is_exact_for_sums_and_near_for_products(spark, instances):
    got = phi(explain.shapley(instances, ["i"], ["a", "b", "c"], BACKGROUND, linear, "kernel", permutations=6))
    want = phi(explain.shapley(instances, ["i"], ["a", "b", "c"], BACKGROUND, linear))
    assert got == pytest.approx(want)
    columns = [f"f{j}" for j in range(15)]
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.normal(size=15))) for i in range(3)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{c} double" for c in columns))
    background = [{"w": 0.5, **{c: v for c in columns}} for v in (0.0, 0.5)]
    score = lambda d: d.withColumn("p", F.col("f0") * F.col("f1") + F.col("f2") * F.col("f3") + sum(F.col(c) for c in columns))
    out = explain.shapley_within(df, ["i"], columns, background, score, error=0.02, pairs=100, most_rounds=8)
    got = {(r.i, r.feature): (r.attribution, r.error) for r in out.collect()}
    worst = [r.base + sum(got[r.i, c][0] for c in columns) - r.prediction for r in out.select("i", "base", "prediction").distinct().collect()]
    assert np.allclose(worst, 0, atol=1e-9)
    # one pair of features at a time: the exact value of a product is known
    for i, *x in rows:
        for a, b in ((0, 1), (2, 3)):
            for j, k in ((a, b), (b, a)):
                exact = np.mean([(x[j] - z) * (x[k] + z) / 2 for z in (0.0, 0.5)]) + np.mean([x[j] - z for z in (0.0, 0.5)])
                value, error = got[i, f"f{j}"]
                assert error <= 0.02 and abs(value - exact) < 5 * 0.02


def test_seconds_per_day(spark, separable):
    from hearthgrid.plans.timing import seconds_per_day

    rows = separable.withColumn("day", F.to_date("ts"))
    out = seconds_per_day(spark, "activity", "none", lambda: rows.groupBy("day", "household_id").agg(F.avg("a").alias("a"))).collect()
    assert len(out) == rows.select("day").distinct().count() and all(r.seconds > 0 for r in out)


def test_growing_index_equals_all_distances_with_less_work():
    from hearthgrid.models.neighbours import GrowingIndex

    work = {}
    for days in (20, 160):
        rng = np.random.default_rng(days)
        x = np.column_stack([rng.uniform(0, 360, 24 * days), rng.normal(size=24 * days), rng.integers(0, 3, 24 * days)])
        x[5::24] = x[4::24]  # equal rows: the earlier one counts
        y = (rng.random(24 * days) < 0.4).astype(float)
        index = GrowingIndex(0)
        for d in range(1, days):
            index.add(x[24 * (d - 1) : 24 * d], y[24 * (d - 1) : 24 * d])
            for i in range(24 * d, 24 * d + 24, 7):
                order = np.lexsort((np.arange(24 * d), ((x[: 24 * d] - x[i]) ** 2).sum(axis=1)))[:5]
                assert index.share(x[i], 5) == pytest.approx(y[order].mean())
        work[days] = index.compared / days
    # a day of eight times as many days costs far less than eight times as much
    assert work[160] < 3 * work[20]


def test_array_hashes_are_those_of_spark(spark):
    from datetime import date

    from hearthgrid.functions import hashes

    texts = ["", "abc", "Dishwasher", "Washing Machine", "a text of more than thirty-two bytes, é and so on, " * 2, None]
    rows = [(7, i - 2, 2**40 * (i - 3), t, None if i == 1 else date(2024, 1, 1 + i), at(i), i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "s int, a int, b long, t string, d date, ts timestamp_ntz, n int").repartition(1)
    out = df.select("*", F.xxhash64("s", "a", "b", "t", "d", "ts").alias("want")).toArrow().combine_chunks()
    keys = [hashes.plain(out[c].combine_chunks()) for c in ("s", "a", "b", "t", "d", "ts")]
    for i, want in enumerate(out["want"].to_pylist()):
        state = np.array([hashes.SEED], np.uint64)
        for values, wide in keys:
            state = hashes.with_value(state, values[i], wide)
        assert int(state.astype(np.int64)[0]) == want


def test_explanations_on_arrays_equal_those_on_rows(spark, separable):
    ids = ["household_id", "ts"]
    model = pooled.fit("logit", separable, COLS, "y")
    few = separable.limit(12).unionByName(separable.limit(2))  # two rows come twice
    few = few.withColumn("household_id", F.when(F.col("household_id") != 2, F.col("household_id")))
    background, scales = explain.sample_background(separable, COLS, 9), explain.feature_scales(separable, COLS)
    jobs = {
        "attribution": lambda **more: explain.shapley(few, ids, COLS, background, model.score, **more),
        "weight": lambda **more: explain.lime(few, ids, COLS, scales, model.score, samples=300, **more),
    }

    def refused(df):
        raise AssertionError("rows were made")

    for column, job in jobs.items():
        rest = {"attribution": ["value", "base", "prediction"], "weight": ["value", "local_pred"]}[column]
        want, got = (
            {(r.household_id, r.ts, r.feature): [r[c] for c in [column, *rest]] for r in df.collect()}
            for df in (job(), job(on_arrays=model.on_arrays()))
        )
        assert len(got) == 24 and got.keys() == want.keys()
        for k, v in want.items():
            assert got[k] == pytest.approx(v, abs=1e-9)
    explain.lime(few, ids, COLS, scales, refused, samples=30, on_arrays=model.on_arrays()).collect()
    explain.shapley(few, ids, COLS, background, refused, on_arrays=model.on_arrays()).collect()
