"""Trees on cells, in one task and over all tasks, and models refitted every day."""

import itertools
import math

import numpy as np
import pytest
from conftest import at
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hearthgrid.models import additive, attributions, cells, daily, per_entity, search
from hearthgrid.models import trees as T
from hearthgrid.operators import explain

COLS = ["a", "b", "c"]


def sample(n=500, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.normal(size=n).round(1), rng.integers(0, 2, n)]).astype(float)
    y = (x[:, 0] / 6 - 1 + x[:, 1] + 0.8 * x[:, 2] * (x[:, 0] > 6) + 0.7 * rng.normal(size=n) > 0).astype(float)
    return x, y


@pytest.fixture(scope="module")
def frame(spark):
    x, y = sample()
    rows = [(i % 3, at(i // 3), *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "household_id int, ts timestamp_ntz, a double, b double, c double, y int").cache()


def counted(x, y):
    bins = T.Bins.of(x)
    codes, of = np.unique(bins.codes(x), axis=0, return_inverse=True)
    n, ones = np.bincount(of.reshape(-1)).astype(float), np.bincount(of.reshape(-1), y)
    return bins, codes, of.reshape(-1), n, ones


@pytest.mark.parametrize("lam, alpha", [(0.0, 1.0), (0.5, 0.5), (1.0, 0.0)])
def test_boosted_split_is_the_best_of_all(lam, alpha):
    x, y = sample(200)
    bins, codes, _, n, ones = counted(x, y)
    (tree, *_), _ = T.boost(codes, bins.sizes, n[None], ones[None], 1, 1, 1.0, lam, alpha)
    g, h = 0.5 - y, np.full(len(y), 0.25)
    shrink = lambda v: math.copysign(max(abs(v) - alpha, 0), v)
    q = lambda m: shrink(g[m].sum()) ** 2 / (h[m].sum() + lam)
    best = max(
        (q(x[:, j] <= t) + q(x[:, j] > t), -j, -t) for j in range(3) for t in bins.thresholds[j]
        if h[x[:, j] <= t].sum() >= 1 and h[x[:, j] > t].sum() >= 1
    )
    j, t = -best[1], -best[2]
    assert tree.feature[0] == j and bins.thresholds[j][tree.cut[0]] == t
    left = x[:, j] <= t
    want = [-shrink(g[m].sum()) / (h[m].sum() + lam) for m in (left, ~left)]
    assert tree.value[1:3] == pytest.approx(want) and tree.cover[1:3] == pytest.approx([h[left].sum(), h[~left].sum()])


def test_models_side_by_side_equal_single_ones():
    x, y = sample(300)
    bins, codes, _, n, ones = counted(x, y)
    rate, depth, lam = np.array([0.1, 0.5, 1.0]), np.array([2, 3, 6]), np.array([0.0, 0.5, 1.0])
    held = [np.repeat(v[None], 3, axis=0) for v in (n, ones)]
    _, margin = T.boost(codes, bins.sizes, *held, 5, depth, rate, lam, 1 - lam)
    for k in range(3):
        _, one = T.boost(codes, bins.sizes, n[None], ones[None], 5, int(depth[k]), rate[k], lam[k], 1 - lam[k])
        assert margin[k] == pytest.approx(one[0], abs=1e-12)


def test_smaller_forest_is_the_start_of_the_larger(monkeypatch):
    x, y = sample(300)
    bins, codes, _, n, ones = counted(x, y)
    large, node = T.forest(codes, bins.sizes, n, ones, 6, 20)
    monkeypatch.setattr(T, "MAX_ENTRIES", 20_000)  # few trees grow at once
    small, few = T.forest(codes, bins.sizes, n, ones, 6, 7)
    assert np.array_equal(large.value[node[:7]], small.value[few])
    assert np.array_equal(small.values(codes).T, small.value[few])


def test_over_tasks_equals_one_task(frame, monkeypatch):
    together = cells.fit_boosting(frame, COLS, "y", 0.3, 4, 13, 0.5, 0.5), cells.fit_ada(frame, COLS, "y", 0.5, 12)
    monkeypatch.setattr(cells, "IN_ONE_TASK", 0)
    spread = cells.fit_boosting(frame.repartition(5), COLS, "y", 0.3, 4, 13, 0.5, 0.5), cells.fit_ada(frame, COLS, "y", 0.5, 12)
    x, _ = sample()
    for one, other in zip(together, spread):
        assert np.array_equal(one.trees.feature, other.trees.feature) and np.array_equal(one.trees.cut, other.trees.cut)
        assert one.margins(x) == pytest.approx(other.margins(x), abs=1e-9)


def test_bins_keep_values_and_are_bounded(spark):
    df = spark.range(0, 1000).select((F.col("id") % 7).alias("few"), F.col("id").cast("double").alias("many"), F.lit(2.0).alias("one"))
    few, many, one = cells.bins_of(df, ["few", "many", "one"], 50).thresholds
    assert few.tolist() == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5] and len(one) == 0
    assert 40 <= len(many) < 50


def test_flattened_forest_scores_as_the_library(frame):
    rows = VectorAssembler(inputCols=COLS, outputCol="features").transform(frame)
    library = RandomForestClassifier(labelCol="y", maxDepth=5, numTrees=9, seed=3).fit(rows)
    want = library.transform(rows).select("ts", "household_id", vector_to_array("probability")[1].alias("want"))
    got = cells.flattened(library, COLS).score(frame)
    gap = got.join(want, ["ts", "household_id"]).agg(F.max(F.abs(F.col("p") - F.col("want")))).first()[0]
    assert gap < 1e-9


def test_unknown_features_have_no_score(spark, frame):
    model = cells.fit_boosting(frame, COLS, "y", n_estimators=2)
    df = spark.createDataFrame([(1, 1.0, None, 0.0), (2, 1.0, 0.5, 0.0)], "i int, a double, b double, c double")
    assert [r.p is None for r in model.score(df).orderBy("i").collect()] == [True, False]
    assert model.score(df.limit(0)).count() == 0


# --- attributions by path ---


def background_of(frame, n=7):
    return explain.sample_background(frame, COLS, n)


@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_background_paths_equal_all_coalitions(frame, kind):
    if kind == "forest":
        model = cells.fit_forest(frame, COLS, "y", 4, 12)
    else:
        model = cells.fit_boosting(frame, COLS, "y", 0.5, 3, 8)
        model.link = "identity"  # coalitions of the margin
    ids, rows = ["household_id", "ts"], frame.limit(20)
    want = explain.shapley(rows, ids, COLS, background_of(frame), model.score)
    got = attributions.tree_shapley(rows, ids, model, background_of(frame))
    both = got.join(want.select(*ids, "feature", *[F.col(c).alias(f"want_{c}") for c in ("attribution", "base", "prediction")]), [*ids, "feature"])
    gaps = both.agg(*[F.max(F.abs(F.col(c) - F.col(f"want_{c}"))) for c in ("attribution", "base", "prediction")], F.count("*")).first()
    assert gaps[3] == 60 and max(gaps[:3]) < 1e-9


def test_cover_paths_equal_all_coalitions_of_shares(frame):
    model = cells.fit_boosting(frame, COLS, "y", 0.5, 4, 3)
    trees, m = model.trees, len(COLS)
    x, _ = sample(6, 3)
    codes = model.bins.codes(x)

    def value(node, row, known):
        f = int(trees.feature[node])
        if f < 0:
            return trees.value[node]
        left = int(trees.left[node])
        if f in known:
            return value(left + int(row[f] > trees.cut[node]), row, known)
        return sum(trees.cover[c] * value(c, row, known) for c in (left, left + 1)) / trees.cover[node]

    phi, base = attributions.by_cover(attributions.Paths.of(trees), codes, m)
    total = lambda row, known: sum(value(r, row, known) for r in trees.roots)
    for i, row in enumerate(codes):
        assert base == pytest.approx(total(row, ()))
        for j in range(m):
            rest = [k for k in range(m) if k != j]
            want = sum(
                math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) * (total(row, (*known, j)) - total(row, known))
                for s in range(m) for known in itertools.combinations(rest, s)
            )
            assert phi[i, j] == pytest.approx(want, abs=1e-10)


def test_probability_attributions_add_up(frame):
    model = cells.fit_boosting(frame, COLS, "y", 0.5, 3, 8)
    out = attributions.tree_shapley(frame.limit(30), ["household_id", "ts"], model, background_of(frame))
    sums = out.groupBy("household_id", "ts").agg(F.sum("attribution").alias("s"), F.first("base").alias("b"), F.first("prediction").alias("p"))
    assert sums.where(F.abs(F.col("s") - (F.col("p") - F.col("b"))) > 1e-9).count() == 0
    with pytest.raises(ValueError):
        attributions.tree_shapley(frame, ["ts"], model, [], "coalitions")


# --- every day ---


@pytest.mark.parametrize("name, params", [
    ("random forest", {"n_estimators": 6, "max_depth": 4}), ("xgboost", {"n_estimators": 4, "max_depth": 3, "reg_alpha": 0.3}),
    ("ada", {"n_estimators": 5, "learning_rate": 1.0}), ("ebm", {"rounds": 3, "interactions": 1}),
])
def test_daily_models_equal_models_of_the_rows_before(monkeypatch, name, params):
    monkeypatch.setattr(daily, "DAYS_HELD", 3)
    x, y = sample(160)
    day = np.arange(160) // 20
    y[:20] = 1  # the second day has training rows of one class
    p, train_auc = daily.walk(x, y, day, name, True, params)
    bins = T.Bins.of(x)
    codes, of = np.unique(bins.codes(x), axis=0, return_inverse=True)
    of = of.reshape(-1)
    assert np.isnan(p[:40]).all() and not np.isnan(p[40:]).any()
    for d in range(2, 8):
        n, ones = (np.bincount(of[day < d], w, len(codes)) for w in (np.ones(20 * d), y[: 20 * d]))
        one = daily.probabilities(name, codes, bins.sizes, n[None], ones[None], **params)[0]
        assert p[day == d] == pytest.approx(one[of[day == d]], abs=1e-12)
        want = per_entity.rank_auc(y[day < d], one[of[day < d]])
        assert train_auc[day == d] == pytest.approx(want)


def test_daily_trees_as_a_job(spark, frame):
    out = per_entity.walk_forward(frame, ["household_id"], "ts", COLS, "y", "xgboost", n_estimators=5, max_depth=3)
    scored = out.where("p is not null")
    assert out.count() == 500 and scored.count() > 400
    assert {r.reason for r in out.where("p is null").select("reason").distinct().collect()} == {daily.FEW_CLASSES}
    odd = frame.limit(3).select("household_id", "ts", F.lit(None).cast("double").alias("a"), "b", "c", "y")
    assert {r.reason for r in per_entity.walk_forward(odd, ["household_id"], "ts", COLS, "y", "ada").collect()} == {"missing features"}
    assert per_entity.walk_forward(frame.limit(0), ["household_id"], "ts", COLS, "y", "ada").count() == 0


@pytest.mark.parametrize("name", ["logit", "knn", "ada"])
def test_cold_start_scores_the_whole_period(frame, name):
    params = {"n_estimators": 4} if name == "ada" else {}
    got = {(r.household_id, str(r.day)): r.score for r in per_entity.cold_start(frame, ["household_id"], "ts", COLS, "y", name, **params).collect()}
    rows = frame.where("household_id = 1").orderBy("ts").toPandas()
    x, y = rows[COLS].to_numpy(), rows["y"].to_numpy(float)
    day = rows["ts"].dt.strftime("%Y-%m-%d").to_numpy()
    for d in sorted(set(day))[1:]:
        known = day < d
        if name == "logit":
            p = per_entity.predict_logistic(per_entity.fit_logistic(x[known], y[known]), x)
        elif name == "knn":
            p = per_entity.NearestRows(x, y).predict(np.flatnonzero(known), np.arange(len(y)))
        else:
            bins = T.Bins.of(x)
            n, ones = known.astype(float), np.where(known, y, 0.0)
            p = daily.probabilities("ada", bins.codes(x), bins.sizes, n[None], ones[None], **params)[0]
        assert got[1, d] == pytest.approx(per_entity.rank_auc(y, p), abs=1e-6)


def test_cell_auc_counts_ties():
    n, ones, p = np.array([3.0, 2, 4]), np.array([1.0, 2, 0]), np.array([0.5, 0.5, 0.1])
    y = np.repeat([1, 0, 1, 0], [1, 2, 2, 4]).astype(float)
    assert daily.cell_auc(n, ones, p) == pytest.approx(per_entity.rank_auc(y, np.repeat([0.5, 0.1], [5, 4])))
    assert daily.cell_auc(n, n, p) is None


# --- search ---


def test_grid_has_all_sets_and_equals_separate_fits(frame):
    few = frame.where("household_id < 2")
    rows = search.grid_scores(few, ["household_id"], "ts", COLS, "y", period=2).collect()
    got = {(r.household_id, r.model, r.params): r.value for r in rows}
    assert len(got) == len(rows) == 2 * 78
    assert len({r.params for r in rows if r.model == "xgboost"}) == 36

    data = few.where("household_id = 1").orderBy("ts").toPandas()
    x, y = data[COLS].to_numpy(), data["y"].to_numpy(float)
    day = data["ts"].dt.dayofyear.to_numpy()
    bins = T.Bins.of(x)
    codes, of = np.unique(bins.codes(x), axis=0, return_inverse=True)
    of = of.reshape(-1)

    def separate(fit):
        scored = []
        for target in search.periods(day, 2):
            known = day < day[target].min()
            if len(np.unique(y[known])) == 2:
                n, ones = (np.bincount(of[known], w, len(codes)) for w in (np.ones(known.sum()), y[known]))
                scored.append((y[target], fit(n, ones)[of[target]]))
        return per_entity.rank_auc(*map(np.concatenate, zip(*scored)))

    forest = separate(lambda n, ones: daily.probabilities("random forest", codes, bins.sizes, n[None], ones[None], max_depth=10, n_estimators=100)[0])
    for features in ("auto", "sqrt"):
        assert got[1, "random forest", f"max_depth=10, max_features={features}, n_estimators=100"] == pytest.approx(forest)
    ada = separate(lambda n, ones: daily.probabilities("ada", codes, bins.sizes, n[None], ones[None], n_estimators=50, learning_rate=0.1)[0])
    assert got[1, "ada", "learning_rate=0.1, n_estimators=50"] == pytest.approx(ada)
    boosted = separate(lambda n, ones: daily.probabilities(
        "xgboost", codes, bins.sizes, n[None], ones[None], learning_rate=0.3, max_depth=6, reg_lambda=0.5, reg_alpha=0.5)[0])
    assert got[1, "xgboost", "learning_rate=0.3, max_depth=6, reg_alpha=0.5, reg_lambda=0.5"] == pytest.approx(boosted)


# --- additive models ---


def test_shapes_add_up_and_find_interactions(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 4, (800, 3)).astype(float)
    y = ((x[:, 0] > 1) ^ (x[:, 2] > 1)).astype(int)  # no feature tells anything alone
    df = spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))], "i int, a double, b double, c double, y int")
    model = additive.fit_additive(df, COLS, "y", rounds=30, interactions=1)
    assert model.names() == ["a", "b", "c", "a x c"]
    parts = model.contributions(df, ["i"]).groupBy("i").agg(F.sum("contribution").alias("s"), F.count("*").alias("n"))
    both = model.score(df).join(parts, "i")
    gap = F.abs(F.col("p") - 1 / (1 + F.exp(-F.col("s") - model.shapes.intercept)))
    assert both.where((gap > 1e-9) | (F.col("n") != 4)).count() == 0
    assert both.where((F.col("p") > 0.5) != (F.col("y") == 1)).count() == 0
    assert additive.fit_additive(df, COLS, "y", rounds=30, interactions=0).names() == COLS
    rows = model.table()
    assert sum(r[0] == "a x c" for r in rows) == 16 and [r[2:4] for r in rows if r[0] == "b"][0] == (None, 0.5)


def test_additive_over_tasks_equals_one_task(frame, monkeypatch):
    one = additive.fit_additive(frame, COLS, "y", bins=8, rounds=2, interactions=1)
    monkeypatch.setattr(cells, "IN_ONE_TASK", 0)
    spread = additive.fit_additive(frame.repartition(4), COLS, "y", bins=8, rounds=2, interactions=1)
    x, _ = sample()
    codes = one.bins.codes(x)
    assert one.names() == spread.names()
    assert one.shapes.margins(codes) == pytest.approx(spread.shapes.margins(codes), abs=1e-9)


def test_additive_models_side_by_side_equal_single_ones(monkeypatch):
    x, y = sample(300, 5)
    bins, codes, of, *_ = counted(x, y)
    day = np.arange(300) // 30
    n, ones = (np.array([np.bincount(of[day < d], w[day < d], len(codes)) for d in (2, 4, 9)]) for w in (np.ones(300), y))
    calls = []
    boost = additive.boost
    monkeypatch.setattr(additive, "boost", lambda *a: calls.append(1) or boost(*a))
    got = daily.probabilities("ebm", codes, bins.sizes, n, ones, rounds=4, interactions=2)
    assert len(calls) == 1  # no model takes steps of its own
    for k in range(3):
        one = additive.fit_cells(codes, bins.sizes, n[k], ones[k], 4, 2)
        assert np.array_equal(got[k], T.logistic(one.margins(codes)))


def test_line_steps_equal_a_search_of_both_levels():
    rng = np.random.default_rng(2)
    g, h = rng.normal(size=(40, 9)).round(1), rng.integers(0, 3, (40, 9)) / 2
    g[h == 0] = 0
    g[:4, 1:], h[:4, 1:] = 0, 0

    def tree(g, h, depth):
        value = np.full(len(g), -g.sum() / (h.sum() + 1))
        q = lambda a, b: a.sum() ** 2 / (b.sum() + 1)
        gains = [q(g[:k], h[:k]) + q(g[k:], h[k:]) if min(h[:k].sum(), h[k:].sum()) >= 1 else 0 for k in range(1, len(g))]
        if not depth or not gains or max(gains) - q(g, h) <= 1e-9:
            return value
        k = int(np.argmax(np.round(gains, 12))) + 1
        return np.concatenate([tree(g[:k], h[:k], depth - 1), tree(g[k:], h[k:], depth - 1)])

    for width in (1, 2, 9):
        want = [tree(a, b, 2) for a, b in zip(g[:, :width], h[:, :width])]
        assert additive.line_steps(g[:, :width], h[:, :width]) == pytest.approx(np.array(want))


def test_patterns_of_leaves_equal_single_pairs():
    x, y = sample(400, 7)
    bins, codes, _, n, ones = counted(x, y)
    paths = attributions.Paths.of(T.forest(codes, bins.sizes, n, ones, 6, 20)[0])
    rows, other = bins.codes(sample(30, 8)[0]), bins.codes(sample(50, 9)[0])
    weight = np.arange(1, 51) / 1275
    want = np.einsum("b,brf->rf", weight, attributions.by_background(paths, rows, other, 3))
    assert attributions.by_weighted_background(paths, rows, other, weight, 3) == pytest.approx(want, abs=1e-9)


def test_equal_rows_are_explained_once(frame, monkeypatch, tmp_path):
    model = cells.fit_forest(frame, COLS, "y", 3, 5)
    few = frame.limit(10)
    many = few.crossJoin(frame.sparkSession.range(200).withColumnRenamed("id", "k"))
    found = attributions.attributions

    def noted(model, paths, x, *rest):
        with open(tmp_path / "rows", "a") as f:
            f.write(f"{len(x)}\n")
        return found(model, paths, x, *rest)

    monkeypatch.setattr(attributions, "attributions", noted)
    out = attributions.tree_shapley(many, ["household_id", "ts", "k"], model, background_of(frame))
    assert out.count() == 10 * 200 * 3
    one = attributions.tree_shapley(few, ["household_id", "ts"], model, background_of(frame))
    assert one.count() == 30 and one.exceptAll(out.where("k = 7").drop("k")).count() == 0


def naive_forest(codes, sizes, ones, n, depth, per_node, number):
    """Share of ones of the leaf of each cell in one tree, with the splits searched node by node."""
    out = np.zeros(len(codes))

    def split(at, level, path):
        out[at] = ones[at].sum() / max(n[at].sum(), 1)
        live = at[n[at] > 0]
        can = [f for f in range(len(sizes)) if len(set(codes[live, f])) > 1]
        if level == depth or not can:
            return
        priority = T.uniform(np.array([number]), np.array([path], np.uint64), len(sizes))[0]
        q = lambda v: ones[v].sum() ** 2 / n[v].sum()
        best = (1e-9, None, None)
        for f in sorted(sorted(can, key=lambda f: priority[f])[:per_node]):
            for c in range(sizes[f] - 1):
                left, right = live[codes[live, f] <= c], live[codes[live, f] > c]
                if len(left) and len(right) and q(left) + q(right) - q(live) > best[0] + 1e-12:
                    best = (q(left) + q(right) - q(live), f, c)
        if best[1] is not None:
            upper = codes[at, best[1]] > best[2]
            split(at[~upper], level + 1, 2 * path)
            split(at[upper], level + 1, 2 * path + 1)

    split(np.arange(len(codes)), 0, 1)
    return out


@pytest.mark.parametrize("packed", [True, False])
def test_drawn_trees_equal_a_search_node_by_node(monkeypatch, packed):
    if not packed:
        monkeypatch.setattr(T, "PACKED", 2)
    monkeypatch.setattr(T, "DRAWN_AT_ONCE", 700)  # some trees at a time
    x, y = sample(250, 11)
    x = np.column_stack([x, np.arange(250) % 70, np.zeros(250)])  # more bins than a word has bits, and one bin
    bins, codes, _, n, ones = counted(x, y)
    rng = np.random.default_rng(0)
    n = np.array([rng.poisson(n) for _ in range(8)])
    n[5] = 0  # a tree without rows
    ones = np.minimum(n, np.array([rng.poisson(ones) for _ in range(8)]))
    for depth in (1, 7):
        trees, node = T.grow_drawn(codes, bins.sizes, ones, n, depth, 2, np.arange(8) + 3)
        for t in range(8):
            want = naive_forest(codes, bins.sizes, ones[t].astype(float), n[t].astype(float), depth, 2, t + 3)
            assert trees.value[node[t]] == pytest.approx(want, abs=1e-12)
        assert np.array_equal(trees.upto(codes, 7), node)


def test_first_levels_are_the_shallower_forest():
    x, y = sample(300)
    bins, codes, _, n, ones = counted(x, y)
    deep, _ = T.forest(codes, bins.sizes, n, ones, 12, 15)
    flat, node = T.forest(codes, bins.sizes, n, ones, 4, 15)
    assert np.array_equal(deep.value[deep.upto(codes, 4)], flat.value[node])
    assert sum(f.startswith("random forest") for f in search.FAMILIES) == 2


def test_histograms_are_made_of_open_nodes_only(monkeypatch):
    x, y = sample(300)
    bins, codes, _, n, ones = counted(x, y)
    seen, best = [], T.best_splits
    monkeypatch.setattr(T, "best_splits", lambda g, h, *a: seen.append(h) or best(g, h, *a))
    T.boost(codes, bins.sizes, n[None], ones[None], 4, 5)
    first = int(bins.sizes[0])
    assert seen and min(h[:, :first].sum(axis=1).min() for h in seen) >= 2 - 1e-6 and len(seen) <= 4 * 5
