import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthgrid.models.per_entity import rank_auc
from hearthgrid.operators import metrics


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, y int, p double")


def test_auc_with_ties_order_and_single_class(spark):
    rng = random.Random(4)
    rows = [(1, rng.randint(0, 1), rng.randint(0, 20) / 20) for _ in range(400)]
    rows += [(2, int(i > 5), i / 10) for i in range(10)] + [(3, int(i < 5), i / 10) for i in range(10)]
    rows += [(4, 1, 0.3), (4, 1, 0.5)]
    got = {r.k: r.auc for r in metrics.auc(frame(spark, rows), ["k"], "y", "p").collect()}
    ours = [(y, p) for k, y, p in rows if k == 1]
    pairs = [
        1.0 if p > q else 0.5 if p == q else 0.0
        for y, p in ours if y == 1 for z, q in ours if z == 0
    ]
    assert got[1] == pytest.approx(sum(pairs) / len(pairs))
    assert got[1] == pytest.approx(rank_auc(np.array([y for y, _ in ours]), np.array([p for _, p in ours])))
    assert got[2] == 1.0 and got[3] == 0.0 and got[4] is None
    overall = metrics.auc(frame(spark, rows), [], "y", "p").first().auc
    assert overall == pytest.approx(rank_auc(np.array([r[1] for r in rows]), np.array([r[2] for r in rows])))


def days_reference(scores, tolerance, lower):
    best = max((s for s in scores if s is not None), default=None)
    ok = lambda s: s is not None and (s < tolerance if lower else s > best * (1 - tolerance))
    for n in range(1, len(scores) + 2):
        if all(ok(s) for s in scores[n - 1 :]):
            return n


def test_cold_start_days_match_a_scan(spark):
    rng = random.Random(6)
    cases = [[0.9] * 5, [0.1] * 5, [0.9, 0.95, 0.2, 0.93, 0.94], [None, 0.9], [0.9, None]]
    cases += [[rng.choice([None, rng.random()]) for _ in range(8)] for _ in range(10)]
    rows = [
        (k, lower, day, s) for k, c in enumerate(cases) for lower in (True, False) for day, s in enumerate(c)
    ]
    df = spark.createDataFrame(rows, "k int, low boolean, day int, score double")
    out = metrics.cold_start_days(df, ["k", "low"], [0.05, 0.5], F.col("low")).collect()
    assert len(out) == len(cases) * 4
    for r in out:
        if any(s is not None for s in cases[r.k]):
            assert r.cold_start_days == days_reference(cases[r.k], r.tolerance, r.low), r


def test_decision_scores_and_zero_denominators(spark):
    rows = [(1, 0.9, 0.8), (1, 0.6, 0.4), (1, 0.2, 0.7), (1, 0.1, 0.1), (2, 0.1, 0.2)]
    df = spark.createDataFrame(rows, "k int, m double, s double")
    got = {r.k: (r.accuracy, r.precision, r.recall) for r in metrics.confusion_scores(df, ["k"], "m", "s").collect()}
    assert got == {1: (0.5, 0.5, 0.5), 2: (1.0, 0.0, 0.0)}
    err = {r.k: r for r in metrics.surrogate_errors(df, ["k"], "m", "s").collect()}
    assert err[1].maee == pytest.approx(0.2) and err[1].msee == pytest.approx(((0.1 + 0.2 - 0.5) / 4) ** 2)
