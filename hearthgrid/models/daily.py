"""Tree models of one entity, refitted every day, and the search of their parameters (MDL-9, MDL-11, MDL-12).

An entity's rows are counted by feature cell and day. Running sums over the days give the rows and ones of every cell before any day,
so the training data of a day is one line of these sums and no row is read again for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from hearthgrid.models import additive
from hearthgrid.models import trees as T

#: Days whose running sums are held at once.
DAYS_HELD = 32
MODELS = ("random forest", "xgboost", "ada", "ebm")
FEW_CLASSES = "training data has fewer than two classes"


class Prefixes:
    """Cells of the rows of one entity: rows with the same bins, or with the same values if not ``binned``.

    Thresholds come from the features of all rows; labels of a day or later do not enter a prefix.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, day: np.ndarray, binned: bool = True) -> None:
        self.bins = T.Bins.of(x) if binned else None
        self.codes, self.cell_of = np.unique(self.bins.codes(x) if binned else x, axis=0, return_inverse=True)
        self.cell_of, self.y, self.day = self.cell_of.reshape(-1), y, day

    def sums(self, days: np.ndarray, leak_free: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Some of the ascending ``days``, with the rows and ones (day, cell) before each of them; with the day itself if not ``leak_free``."""
        cells = len(self.codes)
        # rows count from the first of the days that has them in its past
        from_day = np.searchsorted(days, self.day, "right" if leak_free else "left")
        before = np.zeros((2, cells))
        for a in range(0, len(days), DAYS_HELD):
            part = days[a : a + DAYS_HELD]
            here = (from_day >= a) & (from_day < a + len(part))
            place = (from_day[here] - a) * cells + self.cell_of[here]
            n, ones = (
                np.bincount(place, w, len(part) * cells).reshape(len(part), cells).cumsum(axis=0) + b
                for w, b in zip((np.ones(int(here.sum())), self.y[here]), before, strict=True)
            )
            before = np.stack([n[-1], ones[-1]])
            yield part, n, ones


def probabilities(model_type: str, codes: np.ndarray, sizes: np.ndarray, n: np.ndarray, ones: np.ndarray, **params) -> np.ndarray:
    """P(1) of every cell by models trained on each line of ``n, ones`` (model, cell)."""
    if model_type == "xgboost":
        params = {"rounds": params.pop("n_estimators", 100), **params}
        return T.logistic(T.boost(codes, sizes, n, ones, **params)[1])
    if model_type == "ada":
        rounds = params.pop("n_estimators", 100)
        margin = np.zeros(n.shape)
        for _, margin in T.ada(codes, sizes, n, ones, rounds, **params):
            pass
        return T.logistic(2 * margin / rounds)
    if model_type == "ebm":
        fitted = additive.fit_side_by_side(codes, sizes, n, ones, **params)
        return np.stack([T.logistic(shapes.margins(codes)) for shapes in fitted])
    out = np.empty(n.shape)
    for k in range(len(n)):
        trees, node = T.forest(codes, sizes, n[k], ones[k], **params)
        out[k] = trees.value[node].mean(axis=0)
    return out


def cell_auc(n: np.ndarray, ones: np.ndarray, p: np.ndarray) -> float | None:
    """AUC of rows that are counted by cell."""
    order = np.argsort(p, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(p[order]) > 0])) if len(p) else np.zeros(0, int)
    pos, all_rows = (np.add.reduceat(w[order], first) if len(first) else np.zeros(0) for w in (ones, n))
    neg = all_rows - pos
    if not pos.sum() or not neg.sum():
        return None
    below = np.cumsum(neg) - neg
    return float((pos * (below + neg / 2)).sum() / (pos.sum() * neg.sum()))


def walk(x: np.ndarray, y: np.ndarray, day: np.ndarray, model_type: str, leak_free: bool, params: dict, parts: int = 1, part: int = 0):
    """``p`` and ``train_auc`` of every row from the model of its day, NaN where its training data has one class only.

    Of ``parts`` parts of the days, every day whose number leaves ``part``, only one is walked; the rows of other days stay NaN.
    """
    p, train_auc = np.full(len(x), np.nan), np.full(len(x), np.nan)
    if not len(x):
        return p, train_auc
    held = Prefixes(x, y, day)
    sizes = held.bins.sizes
    own = np.unique(day)
    for days, n, ones in held.sums(own[own % parts == part], leak_free):
        total, positive = n.sum(axis=1), ones.sum(axis=1)
        fit = np.flatnonzero((positive > 0) & (positive < total))
        if not len(fit):
            continue
        found = probabilities(model_type, held.codes, sizes, n[fit], ones[fit], **params)
        for k, row in zip(fit, found, strict=True):
            today = day == days[k]
            p[today] = row[held.cell_of[today]]
            score = cell_auc(n[k], ones[k], row)
            train_auc[today] = np.nan if score is None else score
    return p, train_auc
