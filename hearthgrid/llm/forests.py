"""Random forests grown level by level over all rows of a table.

A level of all trees is one aggregate: each task counts its rows by tree, node, feature and bin, and the counts of a tree meet in one
group, whose size does not depend on the rows. Counts are whole numbers and draws are hashes of a row's key, so the forest does not
depend on how the rows are dealt to tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from hearthgrid.llm.trees import BINS, FlatTrees

#: Quantiles are taken of values rounded to so many significant digits, so that their counts are few.
DIGITS = 3
L2, LEAST = 1e-6, 2.0
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
COUNTS = pa.schema([("tree", pa.int32()), ("cell", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])
SPLITS = pa.schema(
    [("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()),
     ("threshold", pa.float64()), ("low", pa.float64()), ("high", pa.float64())]
)


def matrix(rows: pa.RecordBatch) -> np.ndarray:
    """Features ``x`` as one row of numbers per row."""
    return rows.column("x").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)


def draws(key: np.ndarray, tree: int) -> np.ndarray:
    """How often ``tree`` draws the row of each key: Poisson numbers of mean 1 by a hash of both."""
    z = key.view(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(_POISSON, ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / (1 << 53), "right")


def edges(rows: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """Below ``bins`` thresholds of each feature: all values but the largest, or where there are more, quantiles of all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch)
            scale = 10.0 ** (DIGITS - 1 - np.floor(np.log10(np.maximum(np.abs(x), 1e-3))))
            for j, column in enumerate((np.round(x * scale) / scale).T):
                value, n = np.unique(column, return_counts=True)
                yield pa.RecordBatch.from_pydict({"feature": pa.array(np.full(len(n), j, np.int32)), "value": value, "n": n})

    counted = rows.select("x").mapInArrow(count, "feature int, value double, n long")
    found = counted.groupBy("feature", "value").agg(F.sum("n").alias("n")).orderBy("feature", "value").toArrow()
    feature, value, n = (found[c].to_numpy() for c in ("feature", "value", "n"))
    cuts = []
    for j in range(feature.max(initial=-1) + 1):
        values, below = value[feature == j], n[feature == j].cumsum()
        if len(values) > bins:
            values = np.unique(values[np.searchsorted(below, np.linspace(0, 1, bins)[:-1] * below[-1], "left")])
            cuts.append(values)
        else:
            cuts.append(values[:-1])
    return cuts


def counter(model: FlatTrees, level: int, cuts: list[np.ndarray], columns: np.ndarray, bins: int) -> Callable:
    """Function that counts a task's rows by tree, label, node of ``level``, feature and bin; empty cells are left out."""
    trees, width, first, nodes = len(model.feature), len(cuts), 2**level - 1, 2**level

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((trees, 2 * nodes * width * bins), np.int32)
        for batch in batches:
            x, y, key = matrix(batch), batch.column("label").to_numpy(), batch.column("key").to_numpy()
            cell = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(cuts)])
            cell += np.arange(width) * bins
            row = np.arange(len(x))
            for t in range(trees):
                node = np.zeros(len(x), np.int64)
                for _ in range(level):
                    node = 2 * node + 1 + (x[row, model.feature[t, node]] > model.threshold[t, node])
                at = ((y * nodes + node - first) * (width * bins))[:, None] + cell
                times = np.where(columns[t, node], draws(key, t)[:, None], 0)
                total[t] += np.bincount(at.ravel(), times.ravel(), total.shape[1]).astype(np.int32)
        for t in range(trees):
            at = np.flatnonzero(total[t])
            if len(at):
                yield pa.RecordBatch.from_pylist([{"tree": t, "cell": at, "n": total[t, at]}], COUNTS)

    return count


def splitter(level: int, cuts: list[np.ndarray], weight: np.ndarray, bins: int) -> Callable:
    """Function that gives each node of a tree its split of most gain, and the shares of label 1 on both sides."""
    shape = (2, 2**level, len(cuts), bins)

    def split(counts: pa.Table) -> pa.Table:
        cell, n = (pc.list_flatten(counts[c]).to_numpy() for c in ("cell", "n"))
        sums = np.bincount(cell, n, math.prod(shape)).reshape(shape) * weight[:, None, None, None]
        (g, h), (g_all, h_all) = ((a[1], a[0] + a[1]) for a in (sums.cumsum(axis=3), sums.sum(axis=3, keepdims=True)))
        gain = g**2 / (h + L2) + (g_all - g) ** 2 / (h_all - h + L2) - g_all**2 / (h_all + L2)
        gain[(h < LEAST) | (h_all - h < LEAST)] = 0
        out = []
        for i, best in enumerate(gain.reshape(len(gain), -1).argmax(axis=1)):
            j, cut = divmod(int(best), bins)
            if gain[i, j, cut] > 1e-9:
                sides = [g[i, j, cut] / h[i, j, cut], (g_all - g)[i, j, cut] / (h_all - h)[i, j, cut]]
                out.append((i, j, cuts[j][cut], *sides))
            elif h_all[i].any():  # all rows go to the left
                seen = int(h_all[i, :, 0].argmax())
                out.append((i, 0, math.inf, g_all[i, seen, 0] / h_all[i, seen, 0], 0.0))
        columns = zip(*out, strict=True) if out else [()] * (len(SPLITS) - 1)
        tree = [counts["tree"][0].as_py()] * len(out)
        return pa.table([pa.array(c, f.type) for c, f in zip([tree, *columns], SPLITS, strict=True)], SPLITS)

    return split


def grow(rows: DataFrame, trees: int, depth: int, share: float, seed: int, bins: int = BINS) -> FlatTrees:
    """Forest on all of ``rows`` (``key`` long, ``label`` 0 or 1, ``x`` features); its totals are the mean shares of label 1.

    Both labels weigh the same. Each node sees about ``share`` of the features. ``rows`` are read once for each level, so they
    should be staged; both labels must be there.
    """
    cuts = edges(rows, bins)
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    weight = np.array([0.5 * sum(sizes.values()) / sizes[y] for y in (0, 1)])
    chance = np.random.default_rng(seed).random((trees, 2**depth - 1, len(cuts)))
    columns = chance <= np.maximum(share, chance.min(axis=2, keepdims=True))
    model = FlatTrees.empty(trees, depth)
    for level in range(depth):
        counted = rows.select("key", "label", "x").mapInArrow(counter(model, level, cuts, columns, bins), from_arrow_schema(COUNTS))
        found = counted.groupBy("tree").applyInArrow(splitter(level, cuts, weight, bins), from_arrow_schema(SPLITS)).toArrow()
        tree, node, feature, threshold, low, high = (found[c].to_numpy() for c in SPLITS.names)
        at = 2**level - 1 + node
        model.feature[tree, at], model.threshold[tree, at] = feature, threshold
        if level == depth - 1:
            model.leaf[tree, 2 * node], model.leaf[tree, 2 * node + 1] = low / trees, high / trees
    return model
