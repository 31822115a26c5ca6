"""One model per household (and device), refitted every day (MDL-1..6, MDL-9).

The rows of an entity are grid rows of its calendar (24 per day at most), so a group
has a bounded size. Spark spreads the entities; inside a group numpy walks over the days.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthgrid.models import daily
from hearthgrid.models.neighbours import GrowingIndex
from hearthgrid.session import spread_out


#: Where the different feature cells exceed this share of the rows, neighbours are searched by an index instead of among the cells.
CELL_SHARE = 0.9
#: Parts that the days of one entity are dealt to at most.
MOST_PARTS = 8


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, c: float = 1.0,
                 max_iter: int = 100, tol: float = 1e-8, n: np.ndarray | float = 1.0) -> np.ndarray:
    """Newton steps for L2 logistic regression; the first weight is the free intercept.

    A line of ``x`` may stand for ``n`` rows with ``y`` ones.
    """
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1]) if w is None else w.copy()
    penalty = np.full(a.shape[1], 1.0 / c)
    penalty[0] = 0.0
    for _ in range(max_iter):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -35, 35)))
        gradient = a.T @ (n * p - y) + penalty * w
        hessian = (a * (n * p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        hessian[0, 0] += 1e-10
        step = np.linalg.solve(hessian, gradient)
        size = np.max(np.abs(step))
        w -= step * min(1.0, 5.0 / size) if size > 0 else 0
        if size < tol:
            break
    return w


def predict_logistic(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(w[0] + x @ w[1:], -35, 35)))


class NearestRows:
    """Share of ones among the nearest earlier rows, found on the distinct feature cells; ties go to the earlier row.

    Calendar features and flags take few values, so distances are computed once between cells,
    and a fold only counts the training rows of each cell.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.y = y
        self.cells, self.cell_of = np.unique(x, axis=0, return_inverse=True)
        self.cell_of = self.cell_of.reshape(-1)
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _ranked(self, cell: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances of all cells from ``cell`` and their order."""
        if cell not in self.found:
            distance = ((self.cells - self.cells[cell]) ** 2).sum(axis=1)
            self.found[cell] = distance, np.argsort(distance, kind="stable")
        return self.found[cell]

    def predict(self, known: np.ndarray, target: np.ndarray, n_neighbors: int = 10) -> np.ndarray:
        """Shares for the rows at ``target`` from the rows at ``known`` (both sorted positions)."""
        k = min(n_neighbors, len(known))
        counts = np.bincount(self.cell_of[known], minlength=len(self.cells))
        ones = np.bincount(self.cell_of[known], self.y[known], len(self.cells))
        share: dict[int, float] = {}
        for cell in set(self.cell_of[target].tolist()):
            distance, order = self._ranked(cell)
            reached = order[np.searchsorted(np.cumsum(counts[order]), k)]
            near = distance < distance[reached]
            edge = known[(distance == distance[reached])[self.cell_of[known]]][: k - int(counts[near].sum())]
            share[cell] = (ones[near].sum() + self.y[edge].sum()) / k
        return np.array([share[c] for c in self.cell_of[target].tolist()])


def predict_knn(train_x: np.ndarray, train_y: np.ndarray, x: np.ndarray, n_neighbors: int = 10) -> np.ndarray:
    """Share of ones among the nearest training rows."""
    both = NearestRows(np.concatenate([train_x, x]), np.concatenate([train_y, np.zeros(len(x))]))
    n = len(train_x)
    return both.predict(np.arange(n), np.arange(n, n + len(x)), n_neighbors)


def rank_auc(y: np.ndarray, p: np.ndarray) -> float | None:
    pos, neg = int((y == 1).sum()), int((y != 1).sum())
    if not pos or not neg:
        return None
    ranks = pd.Series(p).rank(method="average").to_numpy()
    return float((ranks[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg))


def _walk(keys: list[str], order: str, columns: list[str], label: str, model_type: str,
          leak_free: bool, params: dict, parts: int, explain: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        x = rows[columns].to_numpy(dtype=float)
        y = rows[label].to_numpy(dtype=float)
        days = rows["_day"].to_numpy()
        usable = ~np.isnan(x).any(axis=1) & ~np.isnan(y)
        p = np.full(len(rows), np.nan)
        train_auc = np.full(len(rows), np.nan)
        phi, base = np.full(x.shape if explain else (0, 0), np.nan), np.full(len(rows), np.nan)
        reason = np.full(len(rows), None, dtype=object)
        index, held = None, 0
        if model_type == "knn" and usable.any() and len(np.unique(x[usable], axis=0)) > CELL_SHARE * usable.sum():
            # few rows share a cell: an index takes the rows of each day as it passes
            index = GrowingIndex(int(np.argmax(x[usable].std(axis=0))))
            places = np.flatnonzero(usable)
        w, nearest, own = None, None, np.ones(len(rows), bool)
        if model_type in daily.MODELS:
            part = int(rows["_part"].iloc[0])
            p[usable], train_auc[usable] = daily.walk(x[usable], y[usable], days[usable], model_type, leak_free, params, parts, part)
            reason[~usable] = "missing features"
            reason[usable & np.isnan(p)] = daily.FEW_CLASSES
            own, days = days % parts == part, days[:0]
        for day in pd.unique(days):
            today = days == day
            known = usable & (days < day if leak_free else days <= day)
            target = today & usable
            if not target.any():
                reason[today] = "missing features"
                continue
            if len(np.unique(y[known])) < 2:
                reason[today] = daily.FEW_CLASSES
                continue
            if model_type == "logit":
                w = fit_logistic(x[known], y[known], w, **params)
                p[target] = predict_logistic(w, x[target])
                if explain:
                    mean = x[known].mean(axis=0)
                    phi[target], base[target] = w[1:] * (x[target] - mean), w[0] + w[1:] @ mean
                score = rank_auc(y[known], predict_logistic(w, x[known]))
                train_auc[today] = np.nan if score is None else score
            elif index is not None:
                upto = int(np.searchsorted(places, np.flatnonzero(known)[-1], "right"))
                index.add(x[places[held:upto]], y[places[held:upto]])
                held = upto
                p[target] = [index.share(row, params.get("n_neighbors", 10)) for row in x[target]]
            else:
                if nearest is None:
                    places = np.flatnonzero(usable)
                    number = np.cumsum(usable) - 1
                    nearest = NearestRows(x[places], y[places])
                p[target] = nearest.predict(number[np.flatnonzero(known)], number[np.flatnonzero(target)], **params)
            reason[today & ~usable] = "missing features"
        out = rows[[*keys, order]].copy()
        out["label"], out["p"], out["train_auc"], out["reason"] = y, p, train_auc, reason
        if explain:
            out["base"], out["values"], out["phi"] = base, list(x), list(phi)
        return out[own]

    return run


def walk_forward(
    features: DataFrame,
    keys: list[str],
    order: str,
    columns: list[str],
    label: str,
    model_type: str = "logit",
    leak_free: bool = True,
    explain: bool = False,
    **params,
) -> DataFrame:
    """Daily refits per entity: ``keys, order, label, p, train_auc, reason``.

    ``p`` comes from a model fitted on the rows of earlier days. Rows that could not be scored
    have a ``reason``. ``model_type`` is 'logit', 'knn' or one of ``daily.MODELS``, whose days are fitted side by side on running sums
    of feature cells. With ``explain`` (logit only) a row also has ``base, values, phi``: the day's log odds of the mean training row, and
    what each of the ``columns`` adds to them.
    """
    if explain and model_type != "logit":
        raise ValueError("only the logistic model explains itself")
    if model_type not in ("logit", "knn", *daily.MODELS):
        raise ValueError(f"unknown model type {model_type!r}, use 'logit', 'knn' or one of {daily.MODELS}")
    fields = [features.schema[k] for k in [*keys, order]]
    schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in fields]
        + [
            T.StructField("label", T.DoubleType()),
            T.StructField("p", T.DoubleType()),
            T.StructField("train_auc", T.DoubleType()),
            T.StructField("reason", T.StringType()),
        ]
        + [T.StructField("base", T.DoubleType())] * explain
        + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("values", "phi") if explain]
    )
    day = F.unix_date(F.to_date(order)).alias("_day")
    slim = features.select(*keys, order, day, label, *columns)
    parts = 1
    if model_type in daily.MODELS:
        # with fewer entities than tasks, the days of an entity are dealt to several tasks, each with all its rows
        tasks = features.sparkSession.sparkContext.defaultParallelism
        entities = features.select(*keys).distinct().count()
        parts = min(MOST_PARTS, max(1, 2 * tasks // max(entities, 1)))
    slim = slim.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return spread_out(slim, [*keys, "_part"]).groupBy(*keys, "_part").applyInPandas(
        _walk(keys, order, columns, label, model_type, leak_free, params, parts, explain), schema
    ).withColumns({"p": F.nanvl("p", F.lit(None)), "train_auc": F.nanvl("train_auc", F.lit(None))})


def own_attributions(predictions: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """``ids, feature, value, attribution`` of the scored rows of an explaining :func:`walk_forward`, in log odds (XAI-4, XAI-5)."""
    parts = F.arrays_zip(F.array(*map(F.lit, columns)).alias("feature"), F.col("values").alias("value"), F.col("phi").alias("attribution"))
    return predictions.where(F.col("p").isNotNull()).select(*ids, F.inline(parts))


def _prefix_scores(x: np.ndarray, y: np.ndarray, day: np.ndarray, model_type: str, params: dict) -> list[tuple[int, float | None]]:
    """AUC on all rows of the model of each day that has training rows of both classes."""
    if not len(x):
        return []
    held = daily.Prefixes(x, y, day, binned=model_type in daily.MODELS)
    total, positive = (np.bincount(held.cell_of, v, len(held.codes)) for v in (np.ones(len(y)), y))
    nearest, w, out = NearestRows(x, y) if model_type == "knn" else None, None, []
    for days, n, ones in held.sums(np.unique(day)):
        fit = np.flatnonzero((ones.sum(axis=1) > 0) & (ones.sum(axis=1) < n.sum(axis=1)))
        if model_type in daily.MODELS and len(fit):
            found = daily.probabilities(model_type, held.codes, held.bins.sizes, n[fit], ones[fit], **params)
            out += [(int(days[k]), daily.cell_auc(total, positive, p)) for k, p in zip(fit, found, strict=True)]
            continue
        for k in fit:
            if nearest:
                score = rank_auc(y, nearest.predict(np.flatnonzero(day < days[k]), np.arange(len(y)), **params))
            else:
                # the weights of the day before are the start
                w = fit_logistic(held.codes, ones[k], w, n=n[k], **params)
                score = daily.cell_auc(total, positive, predict_logistic(w, held.codes))
            out.append((int(days[k]), score))
    return out


def cold_start(
    features: DataFrame, keys: list[str], order: str, columns: list[str], label: str, model_type: str = "logit", **params
) -> DataFrame:
    """``keys, day, score``: AUC on an entity's whole period of a model trained on the rows before each day (MDL-11).

    Training data grows by adding each day's counts to running sums. Days without training rows of both classes have
    no score; a period of one class has NULL scores.
    """
    if model_type not in ("logit", "knn", *daily.MODELS):
        raise ValueError(f"unknown model type {model_type!r}, use 'logit', 'knn' or one of {daily.MODELS}")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows[keys].iloc[:1]
        rows = rows.dropna(subset=[*columns, label]).sort_values(order, kind="stable")
        x, y = rows[columns].to_numpy(float), rows[label].to_numpy(float)
        scores = _prefix_scores(x, y, rows["_day"].to_numpy(), model_type, params)
        out = pd.DataFrame(scores, columns=["_day", "score"]).astype({"score": float})
        return first.merge(out, how="cross")

    schema = T.StructType(
        [features.schema[k] for k in keys] + [T.StructField("_day", T.IntegerType()), T.StructField("score", T.DoubleType())]
    )
    slim = features.select(*keys, order, F.unix_date(F.to_date(order)).alias("_day"), label, *columns)
    found = spread_out(slim, keys).groupBy(*keys).applyInPandas(run, schema)
    return found.select(*keys, F.date_from_unix_date("_day").alias("day"), F.nanvl("score", F.lit(None)).alias("score"))


def mean_train_auc(predictions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Mean of the training AUC over the daily refits."""
    per_day = predictions.groupBy(*keys, F.to_date(order).alias("day")).agg(
        F.first("train_auc", ignorenulls=True).alias("train_auc")
    )
    return per_day.groupBy(*keys).agg(F.avg("train_auc").alias("auc_train"))
