"""Classifiers trained on all households together (MDL-1..4, MDL-6..11)."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgrid.models import additive, cells
from hearthgrid.models.splits import fold_start
from hearthgrid.operators.metrics import auc
from hearthgrid.session import stage

SCORE = "p"
FITS_AT_ONCE = 4


class Scorer:
    """Fitted classifier: ``score`` adds P(label = 1) as column ``p`` (MDL-8)."""

    def __init__(self, model, columns: list[str]):
        self.model, self.columns = model, columns

    def score(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        p = vector_to_array("probability")[1].alias(SCORE)
        return out.select(*df.columns, p)

    def on_arrays(self) -> Callable[[np.ndarray], np.ndarray]:
        """The same of rows of features, as a function that tasks can take; of a logistic model."""
        fitted = self.model.stages[-1]
        weights, intercept = fitted.coefficients.toArray(), float(fitted.intercept)
        return lambda x: 1.0 / (1.0 + np.exp(-np.clip(x @ weights + intercept, -700, 700)))


def _assembler(columns: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")


def fit_logit(train: DataFrame, columns: list[str], label: str, max_iter: int = 100, c: float = 1.0,
              penalised: bool = True) -> Scorer:
    """L2 logistic regression (MDL-1).

    Spark minimises the mean loss, so the penalty of a summed loss with weight ``c``
    becomes ``1 / (c * n)``. The intercept is not penalised.
    """
    n = train.count()
    lr = LogisticRegression(
        labelCol=label, maxIter=max_iter, regParam=1.0 / (c * n) if penalised and n else 0.0,
        elasticNetParam=0.0, standardization=False,
    )
    return Scorer(Pipeline(stages=[_assembler(columns), lr]).fit(train), columns)


FITTERS: dict[str, Callable[..., Scorer]] = {
    "logit": fit_logit,
    "random forest": cells.fit_forest,
    "xgboost": cells.fit_boosting,
    "ada": cells.fit_ada,
    "ebm": additive.fit_additive,
}


def fit(model_type: str, train: DataFrame, columns: list[str], label: str, **params) -> Scorer:
    """Fit a model by name (MDL-7)."""
    if model_type not in FITTERS:
        raise ValueError(f"unknown model type {model_type!r}, use one of {sorted(FITTERS)}")
    return FITTERS[model_type](train, columns, label, **params)


def shape_table(model: additive.AdditiveModel) -> DataFrame:
    """Values by bin of an additive model's terms: ``feature, bin, lower, upper, other_bin, weight`` (XAI-11)."""
    schema = "feature string, bin int, lower double, upper double, other_bin int, weight double"
    return SparkSession.active().createDataFrame(model.table(), schema)


def folds(features: DataFrame, day: str, refit_every: str = "month") -> list[tuple[str, str]]:
    """First and last day of every refit period in the data; one row per period is collected."""
    start = fold_start(F.col(day), refit_every).alias("first")
    spans = features.groupBy(start).agg(F.max(day).alias("last")).orderBy("first").collect()
    return [(str(r["first"]), str(r["last"])) for r in spans]


def walk_forward(
    features: DataFrame,
    folds: list[tuple[str, str]],
    day: str,
    columns: list[str],
    label: str,
    model_type: str,
    **params,
) -> tuple[DataFrame, list[tuple[str, float | None]], list[tuple[str, str]]]:
    """Fit on the days before each fold and score the fold (MDL-9, MDL-10).

    ``folds`` are ``(first_day, last_day)`` pairs; their number is the number of refits,
    independent of the data size; ``FITS_AT_ONCE`` run side by side and each writes its scores. Returns the scored rows (none if no fold could
    be fitted), the training AUC per fold and the folds that could not be fitted with the reason.
    """
    at = lambda d: F.lit(d).cast("date")

    def one(span: tuple[str, str]) -> tuple[DataFrame, float] | None:
        first, last = span
        known = features.where(F.col(day) < at(first)).na.drop(subset=[*columns, label])
        fold = features.where(F.col(day).between(at(first), at(last))).na.drop(subset=columns)
        if known.select(label).distinct().limit(2).count() < 2:
            return None
        scorer = fit(model_type, known, columns, label, **params)
        scored = stage(scorer.score(fold).withColumn("fold", at(first)), "fold")
        return scored, auc(scorer.score(known), [], label, SCORE).first()["auc"]

    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        found = list(pool.map(one, folds))
    errors = [(span[0], "training data has fewer than two classes") for span, f in zip(folds, found, strict=True) if f is None]
    train_auc = [(span[0], f[1]) for span, f in zip(folds, found, strict=True) if f is not None]
    none = features.limit(0).withColumns({SCORE: F.lit(None).cast("double"), "fold": F.lit(None).cast("date")})
    return reduce(DataFrame.unionByName, [f[0] for f in found if f is not None], none), train_auc, errors
