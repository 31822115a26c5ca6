"""Shapley values of tree models along the paths of their leaves (XAI-3).

A leaf's path bounds each of its features to a range of bins. The value of a leaf for a set of known features is its output times, for each
feature on the path, one or zero if the feature is known (the row keeps to the range or not), else the share of rows that keep to it.
The share is a ratio of covers (``method="cover"``), or the one or zero of a background row over which results are averaged
(``method="background"``). The weighted sum over all sets is a polynomial along the path, so no set is ever listed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from hearthgrid.models.cells import TreeModel
from hearthgrid.models.trees import Trees
from hearthgrid.session import attach, spread_out, stage

#: Entries (rows x leaves x path) that are worked on at once.
AT_ONCE = 2_000_000


@dataclass
class Paths:
    """Leaves by row: their features (-1 fills up), ranges of bins (low, high], shares of covers, and value."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, trees: Trees) -> Paths:
        leaves = []
        for root in trees.roots.tolist():
            stack = [(root, {})]
            while stack:
                node, bounds = stack.pop()
                f = int(trees.feature[node])
                if f < 0:
                    leaves.append((bounds, float(trees.value[node])))
                    continue
                low, high, share = bounds.get(f, (-1, 1 << 30, 1.0))
                cut, left = int(trees.cut[node]), int(trees.left[node])
                for child, a, b in ((left, low, min(high, cut)), (left + 1, max(low, cut), high)):
                    stack.append((child, {**bounds, f: (a, b, share * float(trees.cover[child] / trees.cover[node]))}))
        width = max([1, *(len(b) for b, _ in leaves)])
        shape = (len(leaves), width)
        out = cls(np.full(shape, -1), np.full(shape, -1), np.full(shape, 1 << 30), np.ones(shape), np.array([v for _, v in leaves]))
        for i, (bounds, _) in enumerate(leaves):
            for k, (f, (low, high, share)) in enumerate(sorted(bounds.items())):
                out.feature[i, k], out.low[i, k], out.high[i, k], out.share[i, k] = f, low, high, share
        return out

    def kept(self, codes: np.ndarray, part: slice) -> np.ndarray:
        """Whether each row keeps to each range of each leaf."""
        x = codes[:, self.feature[part]]
        return ((x > self.low[part]) & (x <= self.high[part])) | (self.feature[part] < 0)

    def by_feature(self, parts: np.ndarray, part: slice, width: int) -> np.ndarray:
        """Sums of (row, leaf, place) by feature."""
        feature = self.feature[part].ravel()
        out = np.zeros((len(parts), width))
        flat = parts.reshape(len(parts), -1)
        for f in range(width):
            out[:, f] = flat[:, feature == f].sum(axis=1)
        return out


def by_cover(paths: Paths, codes: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Attributions (row, feature) and base value from the shares of covers.

    The sum over all sets of the other features, weighted as a Shapley value, is the integral from 0 to 1 of the product of
    ``share (1 - t) + kept t`` over them: a polynomial that a Gauss-Legendre rule integrates exactly.
    """
    points, weights = np.polynomial.legendre.leggauss(paths.feature.shape[1] // 2 + 1)
    points, weights = (points + 1) / 2, weights / 2
    out = np.zeros((len(codes), width))
    step = max(1, AT_ONCE // max(1, len(codes) * paths.feature.shape[1]))
    for a in range(0, len(paths.value), step):
        part = slice(a, a + step)
        share, kept = paths.share[part][None], paths.kept(codes, part).astype(float)
        total = np.zeros(kept.shape)
        for t, w in zip(points, weights, strict=True):
            factor = share * (1 - t) + kept * t
            total += w * factor.prod(axis=2, keepdims=True) / factor
        out += paths.by_feature((kept - share) * total * paths.value[part][None, :, None], part, width)
    return out, float((paths.share.prod(axis=1) * paths.value).sum())


def pair_weights(most: int) -> np.ndarray:
    """Weight of a feature that only the row keeps to, by the numbers of features that only the row and only the background keep to."""
    f = math.factorial
    return np.array([[f(a - 1) * f(b) / f(a + b) if a else 0.0 for b in range(most + 1)] for a in range(most + 1)])


def by_background(paths: Paths, codes: np.ndarray, background: np.ndarray, width: int) -> np.ndarray:
    """Attributions (background row, row, feature) against each single row of the background."""
    out = np.zeros((len(background), len(codes), width))
    weight = pair_weights(paths.feature.shape[1])
    step = max(1, AT_ONCE // max(1, len(codes) * paths.feature.shape[1]))
    for a in range(0, len(paths.value), step):
        part = slice(a, a + step)
        kept = paths.kept(codes, part)
        for b, row in enumerate(background):
            other = paths.kept(row[None], part)
            own, theirs = kept & ~other, other & ~kept
            alive = (kept | other).all(axis=2)
            m, n = own.sum(axis=2), theirs.sum(axis=2)
            value = np.where(alive, paths.value[part], 0.0)
            parts = own * (value * weight[m, n])[:, :, None] - theirs * (value * weight[n, m])[:, :, None]
            out[b] += paths.by_feature(parts, part, width)
    return out


def by_weighted_background(paths: Paths, codes: np.ndarray, background: np.ndarray, weight: np.ndarray, width: int) -> np.ndarray:
    """Attributions (row, feature): :func:`by_background` summed over the background with its weights.

    A leaf sees of a row only which of its ranges the row keeps to. So each pair of such patterns, of rows and of the background, is
    worked on once for a leaf. Where both together keep to all ranges, the background's gaps are what only the row keeps to, and the other way round.
    """
    out = np.zeros((len(codes), width))
    places = paths.feature.shape[1]
    full, share = (1 << places) - 1, pair_weights(places)
    bit = 1 << np.arange(places)
    step = max(1, AT_ONCE // max(1, (len(codes) + len(background)) * places, min(len(codes), full + 1) * min(len(background), full + 1)))
    for a in range(0, len(paths.value), step):
        part = slice(a, a + step)
        leaf = np.arange(len(paths.value[part])) << places
        own, row_of = np.unique(leaf + paths.kept(codes, part) @ bit, return_inverse=True)
        theirs, other_of = np.unique(leaf + paths.kept(background, part) @ bit, return_inverse=True)
        total = np.bincount(other_of.ravel(), np.repeat(weight, len(leaf)), len(theirs))
        # every pattern of rows with every pattern of the background at the same leaf
        first, last = (np.searchsorted(theirs, (own >> places) + k << places) for k in (0, 1))
        left = np.repeat(np.arange(len(own)), last - first)
        right = np.arange(len(left)) - np.repeat(np.cumsum(last - first) - last, last - first)
        alive = (own[left] | theirs[right]) & full == full
        left, right = left[alive], right[alive]
        only_row, only_other = full - (theirs[right] & full), full - (own[left] & full)
        m, n = (np.bitwise_count(v).astype(int) for v in (only_row, only_other))
        value = paths.value[part][own[left] >> places] * total[right]
        gain, loss = value * share[m, n], value * share[n, m]
        table, feature = np.zeros((len(own), width)), paths.feature[part][own >> places]
        for k in range(places):
            moved = np.where(only_row & bit[k], gain, 0.0) - np.where(only_other & bit[k], loss, 0.0)
            held = np.flatnonzero(feature[:, k] >= 0)
            table[held, feature[held, k]] += np.bincount(left, moved, len(own))[held]
        for i, at in enumerate(row_of.reshape(len(codes), -1)):
            out[i] += table[at].sum(axis=0)
    return out


def attributions(model: TreeModel, paths: Paths, x: np.ndarray, background: list[dict], method: str, output: str):
    """Attributions (row, feature), base and prediction of rows of features."""
    codes, width = model.bins.codes(x), len(model.columns)
    margin = model.margins(x)
    if method == "cover":
        if output != "margin":
            raise ValueError("shares of covers explain the margin only")
        phi, base = by_cover(paths, codes, width)
        return phi, np.full(len(x), base + model.base), margin
    weight = np.array([b["w"] for b in background])
    z = np.array([[float(b[c]) for c in model.columns] for b in background])
    other = model.margins(z)
    if output == "margin" or model.link == "identity":
        # no pair of rows has a factor of its own
        phi = by_weighted_background(paths, codes, model.bins.codes(z), weight, width)
        return phi, np.full(len(x), float(weight @ other)), margin
    every = by_background(paths, codes, model.bins.codes(z), width)
    # the difference of a pair's probabilities is shared as that of their margins
    gap = margin[None] - other[:, None]
    p, q = model.probability(margin)[None], model.probability(other)[:, None]
    near = np.abs(gap) < 1e-9
    slope = model.probability(other + 5e-7) - model.probability(other - 5e-7)
    every = every * np.where(near, slope[:, None] * 1e6, (p - q) / np.where(near, 1.0, gap))[:, :, None]
    phi = np.einsum("b,brf->rf", weight, every)
    return phi, np.full(len(x), float(weight @ q[:, 0])), p[0]


def tree_shapley(
    instances: DataFrame, ids: list[str], model: TreeModel, background: list[dict] | None = None, method: str = "background",
    output: str = "probability",
) -> DataFrame:
    """Shapley values of a tree model: ``ids, feature, value, attribution, base, prediction`` (XAI-3).

    With a background (rows with a weight ``w``) the values of the margin equal those over all coalitions of features; with
    ``output="probability"`` each background row's difference in probability is shared in proportion to them, which for trees whose leaves
    hold probabilities is the same. The attributions of an instance add up to prediction - base. Rows with an unknown
    feature are left out. Rows with the same features are explained once, and the result is joined to each of them.
    """
    if method not in ("cover", "background") or output not in ("margin", "probability"):
        raise ValueError(f"unknown method {method!r} or output {output!r}")
    paths = Paths.of(model.trees)
    names = model.columns

    values = [f"_{j}" for j in range(len(names))]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in rows.columns])
                phi, base, prediction = attributions(model, paths, x, background or [], method, output)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(phi.tolist(), pa.list_(pa.float64())), pa.array(base), pa.array(prediction)],
                    names=[*values, "_phi", "base", "prediction"],
                )

    known = instances.select(*ids, *[F.col(c).cast("double").alias(f"_{j}") for j, c in enumerate(names)])
    known = known.na.drop(subset=values)
    double = ST.DoubleType()
    schema = ST.StructType(
        [ST.StructField(c, double) for c in values] + [ST.StructField("_phi", ST.ArrayType(double))]
        + [ST.StructField(c, double) for c in ("base", "prediction")]
    )
    explained = stage(spread_out(known.select(*values).distinct(), values).mapInArrow(run, schema), "explained-cells")
    parts = [F.struct(F.lit(c).alias("feature"), F.col(f"_{j}").alias("value"), F.col("_phi")[j].alias("attribution")) for j, c in enumerate(names)]
    return attach(known, explained, values).select(*ids, "base", "prediction", F.inline(F.array(*parts))).select(
        *ids, "feature", "value", "attribution", "base", "prediction"
    )
