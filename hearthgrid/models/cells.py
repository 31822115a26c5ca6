"""Counted feature cells of any table, and models grown on them (MDL-2, MDL-3, MDL-4).

Features are cut into bins and rows with the same bins are counted: calendar features and flags have a few thousand cells whatever
the number of households. A table of few cells is fitted in one task, as it is smaller than what a join would broadcast;
beyond ``IN_ONE_TASK`` cells every level of a tree is one aggregate of gradient sums over all tasks, and the best split of a node
is found beside its sums. Both ways take the same splits.
"""

from __future__ import annotations

import itertools
import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthgrid.models import trees as T
from hearthgrid.session import stage, staging_dir

#: Cells that one task may hold: some ten MB.
IN_ONE_TASK = 200_000
#: Rounds of boosting after which the margins of all cells are written.
ROUNDS_KEPT = 10


def bins_of(train: DataFrame, columns: list[str], most: int = T.MAX_BINS) -> T.Bins:
    """Thresholds halfway between the values of each feature, or between quantiles where it has more than ``most``.

    At most ``most + 1`` values of each feature come to the driver.
    """
    values = train.select(
        F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(c).cast("double").alias("v")) for j, c in enumerate(columns)])).alias("f")
    ).select("f.j", "f.v").distinct()
    # one row for each feature and value
    first = values.withColumn("rank", F.row_number().over(Window.partitionBy("j").orderBy("v"))).where(F.col("rank") <= most + 1)
    found: dict[int, list[float]] = {}
    for r in first.collect():
        found.setdefault(r.j, []).append(r.v)
    wide = [j for j in range(len(columns)) if len(found.get(j, [])) > most]
    if wide:
        shares = [i / (most - 1) for i in range(most)]
        cuts = train.select(*[F.percentile_approx(F.col(columns[j]).cast("double"), shares, 100_000).alias(str(j)) for j in wide]).first()
        found.update({j: sorted(set(cuts[str(j)])) for j in wide})
    ordered = [np.array(sorted(found.get(j, [0.0]))) for j in range(len(columns))]
    return T.Bins([(v[:-1] + v[1:]) / 2 for v in ordered])


@dataclass
class CellTable:
    """Written table ``codes`` (16-bit numbers of the bins), ``n``, ``ones`` and ``margin`` of all cells."""

    bins: T.Bins
    rows: DataFrame
    count: int

    @classmethod
    def of(cls, train: DataFrame, columns: list[str], label: str, bins: T.Bins | None = None) -> CellTable:
        """Cells of the rows of ``train`` whose features and label are known."""
        bins = bins or bins_of(train, columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
                y = batch.column(0).to_numpy(zero_copy_only=False)
                cells, at = np.unique(bins.codes(x).astype("<u2"), axis=0, return_inverse=True)
                n, ones = np.bincount(at.reshape(-1), minlength=len(cells)), np.bincount(at.reshape(-1), y, len(cells))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c.tobytes() for c in cells], pa.binary()), pa.array(n.astype(float)), pa.array(ones)],
                    names=["codes", "n", "ones"],
                )

        doubles = [F.col(c).cast("double").alias(f"_{j}") for j, c in enumerate([label, *columns])]
        counted = train.select(*doubles).na.drop().mapInArrow(run, "codes binary, n double, ones double")
        rows = counted.groupBy("codes").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"), F.lit(0.0).alias("margin"))
        rows = stage(rows, "cells")
        return cls(bins, rows, rows.count())

    def in_one_task(self, fit: Callable[[np.ndarray, np.ndarray, np.ndarray], object]) -> object:
        """What ``fit(codes, n, ones)`` makes of all cells, in the order of their codes."""
        width = len(self.bins.thresholds)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            every = pa.Table.from_batches(list(batches)).sort_by("codes")
            model = fit(*unpacked(every, width)[:3])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

        out = self.rows.coalesce(1).mapInArrow(run, "model binary").first()
        return pickle.loads(out.model)  # noqa: S301 - written by the task above


def unpacked(rows: pa.Table | pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    """``codes, n, ones, margin`` of cells."""
    column = lambda name: np.asarray(rows[name].to_numpy(), float)
    codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), "<u2").reshape(-1, width).astype(np.int64)
    return codes, column("n"), column("ones"), column("margin")


SPLITS = "node int, gain double, slot int, g double, h double"


@dataclass
class Levels:
    """A tree that grows level by level over all tasks."""

    feature: list[np.ndarray]
    cut: list[np.ndarray]
    left: list[np.ndarray]
    value: list[np.ndarray]
    cover: list[np.ndarray]
    first: int = 0
    count: int = 1

    def tree(self) -> T.Trees:
        """The tree as far as it has grown; the nodes of its last level are leaves without a value."""
        nodes = self.first + self.count
        full = lambda parts, fill: np.concatenate([*parts, np.full(nodes - sum(map(len, parts)), fill)])
        return T.Trees(full(self.feature, -1), full(self.cut, -1), full(self.left, -1), full(self.value, 0.0),
                       full(self.cover, 0.0), np.zeros(1, int))

    def add(self, found: pa.Table, starts: np.ndarray, owner: np.ndarray, lam: float, alpha: float, last: bool) -> None:
        """Take the splits of the present level and open the next one."""
        order = np.argsort(found["node"].to_numpy())
        node, gain, slot, g, h = (found[c].to_numpy()[order] for c in ("node", "gain", "slot", "g", "h"))
        value, cover, feature = np.zeros(self.count), np.zeros(self.count), np.full(self.count, -1)
        value[node], cover[node] = T.weight(g, h, lam, alpha), h
        cut, left = feature.copy(), feature.copy()
        parted = (gain > 1e-9) & (not last)
        at = node[parted]
        feature[at] = owner[slot[parted]]
        cut[at] = slot[parted] - starts[feature[at]]
        left[at] = self.first + self.count + 2 * np.arange(len(at))
        for parts, new in zip((self.feature, self.cut, self.left, self.value, self.cover), (feature, cut, left, value, cover), strict=True):
            parts.append(new)
        self.first, self.count = self.first + self.count, 2 * len(at)


Derivatives = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def log_loss(n: np.ndarray, ones: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the logistic loss of cells."""
    p = T.logistic(margin)
    return n * p - ones, n * p * (1 - p)


def level_splits(
    rows: DataFrame, sizes: np.ndarray, done: list[T.Trees], growing: Levels, derivatives: Derivatives, lam: float, alpha: float, least: float
) -> pa.Table:
    """Best split of every node of the growing tree's last level: one aggregate of gradient sums, combined in each task first.

    One row for each node comes to the driver, which holds the tree.
    """
    starts, width, slots = np.concatenate([[0], np.cumsum(sizes)[:-1]]), len(sizes), int(sizes.sum())
    tree, first, count = growing.tree(), growing.first, growing.count

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, n, ones, margin = unpacked(batch, width)
            margin = margin + sum((t.value[t.leaves(codes, 0)] for t in done), np.zeros(len(n)))
            g, h = derivatives(n, ones, margin)
            node = tree.leaves(codes, 0) - first
            live = np.flatnonzero(node >= 0)
            at = (node[live][:, None] * slots + codes[live] + starts).ravel()
            key, place = np.unique(at, return_inverse=True)
            totals = [np.bincount(place, np.repeat(w[live], width), len(key)) for w in (g, h)]
            yield pa.RecordBatch.from_arrays(
                [pa.array((key // slots).astype(np.int32)), pa.array((key % slots).astype(np.int32)), *map(pa.array, totals)],
                names=["node", "slot", "g", "h"],
            )

    def best(table: pa.Table) -> pa.Table:
        g, h = np.zeros((1, slots)), np.zeros((1, slots))
        g[0, table["slot"].to_numpy()], h[0, table["slot"].to_numpy()] = table["g"].to_numpy(), table["h"].to_numpy()
        gain, slot, all_g, all_h = T.best_splits(g, h, sizes, lam, alpha, least)
        return pa.table({
            "node": table["node"][:1].combine_chunks(), "gain": gain, "slot": slot.astype(np.int32), "g": all_g, "h": all_h,
        })

    partial = rows.mapInArrow(sums, "node int, slot int, g double, h double")
    total = partial.groupBy("node", "slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    return total.groupBy("node").applyInArrow(best, SPLITS).toArrow()


def first_splits(table: CellTable, columns: list[str], lam: float, alpha: float) -> DataFrame:
    """``feature, threshold, gain, left_value, right_value`` of every split of the root of a first boosted tree."""
    sizes, width = table.bins.sizes, len(columns)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, n, ones, margin = unpacked(batch, width)
                slots = (codes + starts).ravel()
                totals = [np.bincount(slots, np.repeat(w, width), int(sizes.sum())) for w in log_loss(n, ones, margin)]
                places = [np.repeat(np.arange(width), sizes), np.concatenate([np.arange(k) for k in sizes])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*places, *totals)], names=["j", "bin", "g", "h"])

    found = table.rows.mapInArrow(sums, "j long, bin long, g double, h double").groupBy("j", "bin").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h")
    )
    of_feature = Window.partitionBy("j")
    up_to = of_feature.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    both = found.select("j", "bin", *[F.sum(c).over(up_to).alias(f"left_{c}") for c in "gh"], *[F.sum(c).over(of_feature).alias(c) for c in "gh"])
    cuts = F.array(*[F.array(*map(F.lit, map(float, t))) if len(t) else F.array().cast("array<double>") for t in table.bins.thresholds])
    named = both.select(
        "*", F.get(F.array(*map(F.lit, columns)), F.col("j").cast("int")).alias("feature"),
        F.get(F.get(cuts, F.col("j").cast("int")), F.col("bin").cast("int")).alias("threshold"),
    ).where(F.col("threshold").isNotNull())
    shrunk = lambda g: F.signum(g) * F.greatest(F.abs(g) - alpha, F.lit(0.0))
    quality = lambda g, h: shrunk(g) ** 2 / (h + lam)
    value = lambda g, h: -shrunk(g) / (h + lam)
    left, right, every = (F.col("left_g"), F.col("left_h")), (F.col("g") - F.col("left_g"), F.col("h") - F.col("left_h")), (F.col("g"), F.col("h"))
    return named.select(
        "feature", "threshold", (quality(*left) + quality(*right) - quality(*every)).alias("gain"),
        value(*left).alias("left_value"), value(*right).alias("right_value"),
    )


def ensemble_over_tasks(
    table: CellTable, rounds: int, max_depth: int, derivatives: Derivatives, output: Callable[[np.ndarray], np.ndarray],
    lam: float = 0.0, alpha: float = 0.0, least: float = 1.0,
) -> list[T.Trees]:
    """Trees grown one after the other over cells of any number; ``output`` turns a leaf's value into what it adds to the margin."""
    sizes = table.bins.sizes
    starts, owner = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(sizes)), sizes)
    rows, out, done = table.rows, [], []
    for _ in range(rounds):
        growing = Levels([], [], [], [], [])
        for level in range(max_depth + 1):
            found = level_splits(rows, sizes, done, growing, derivatives, lam, alpha, least)
            growing.add(found, starts, owner, lam, alpha, level == max_depth)
            if not growing.count:
                break
        tree = growing.tree()
        tree.value = output(tree.value)
        out.append(tree)
        done.append(tree)
        if len(done) == ROUNDS_KEPT:
            rows, done = with_margins(rows, done, len(sizes)), []
    return out


def with_margins(rows: DataFrame, done: list[T.Trees], width: int) -> DataFrame:
    """Cells with the margins of further trees added, written."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, n, ones, margin = unpacked(batch, width)
                margin = margin + sum(t.value[t.leaves(codes, 0)] for t in done)
                yield pa.RecordBatch.from_arrays([batch["codes"], pa.array(n), pa.array(ones), pa.array(margin)], names=names)

    return stage(rows.mapInArrow(run, rows.schema), "margins")


@dataclass
class TreeModel:
    """Fitted trees over named features. The margin of a row is ``base`` and the sum of its leaves; ``link`` turns it into P(1).

    ``link`` is ``logistic``, ``half`` (logistic of twice the margin) or ``identity``, for leaves that hold probabilities.
    """

    columns: list[str]
    bins: T.Bins
    trees: T.Trees
    link: str = "logistic"
    base: float = 0.0

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Margins of rows of features; rows with an unknown feature have none."""
        known = ~np.isnan(x).any(axis=1)
        out = np.full(len(x), np.nan)
        codes = self.bins.codes(x[known])
        total = np.full(len(codes), self.base)
        for t in range(len(self.trees.roots)):
            total += self.trees.value[self.trees.leaves(codes, t)]
        out[known] = total
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        if self.link == "identity":
            return margin
        return T.logistic(2 * margin if self.link == "half" else margin)

    def column(self) -> Column:
        """P(1) as a column of the features' columns."""

        @F.pandas_udf("double")
        def p(*features: pd.Series) -> pd.Series:
            x = np.column_stack([f.to_numpy(float) for f in features])
            return pd.Series(self.probability(self.margins(x)))

        return p(*[F.col(c).cast("double") for c in self.columns])

    def splits(self) -> list[tuple]:
        """``tree, feature, threshold, left_value, right_value`` of every split, in the order of the nodes."""
        t, rows = self.trees, []
        tree = np.searchsorted(t.roots, np.arange(len(t.feature)), "right") - 1 if len(t.roots) == 1 else None
        for node in np.flatnonzero(t.feature >= 0).tolist():
            f, left = int(t.feature[node]), int(t.left[node])
            threshold = float(self.bins.thresholds[f][t.cut[node]])
            rows.append((0 if tree is None else int(tree[node]), self.columns[f], threshold, float(t.value[left]), float(t.value[left + 1])))
        return rows

    def score(self, df: DataFrame) -> DataFrame:
        out = df.select(*df.columns, self.column().alias("p"))
        return out.withColumn("p", F.nanvl("p", F.lit(None)))


def fit_boosting(
    train: DataFrame, columns: list[str], label: str, learning_rate: float = 0.1, max_depth: int = 6, n_estimators: int = 100,
    reg_lambda: float = 1.0, reg_alpha: float = 0.0,
) -> TreeModel:
    """Second-order gradient boosting with squared and absolute penalties on leaf values (MDL-3)."""
    table = CellTable.of(train, columns, label)
    sizes = table.bins.sizes
    if table.count > IN_ONE_TASK:
        parts = ensemble_over_tasks(table, n_estimators, max_depth, log_loss, lambda v: learning_rate * v, reg_lambda, reg_alpha)
    else:
        parts = table.in_one_task(
            lambda codes, n, ones: T.boost(codes, sizes, n[None], ones[None], n_estimators, max_depth, learning_rate, reg_lambda, reg_alpha)[0]
        )
    return TreeModel(columns, table.bins, T.joined(parts))


def fit_ada(train: DataFrame, columns: list[str], label: str, learning_rate: float = 0.1, n_estimators: int = 100) -> TreeModel:
    """Real-valued AdaBoost over stumps (MDL-4); P(1) follows from the mean of their half log odds."""
    table = CellTable.of(train, columns, label)
    sizes = table.bins.sizes

    def weighted(n: np.ndarray, ones: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w1, w0 = T.ada_weights(n, ones, margin, learning_rate)
        return -w1, w1 + w0

    if table.count > IN_ONE_TASK:
        parts = ensemble_over_tasks(table, n_estimators, 1, weighted, T.half_log_odds, least=1e-9)
    else:
        parts = table.in_one_task(
            lambda codes, n, ones: [t for t, _ in T.ada(codes, sizes, n[None], ones[None], n_estimators, learning_rate)]
        )
    return TreeModel(columns, table.bins, T.joined(parts).scaled(1 / n_estimators), "half")


def flattened(model, columns: list[str]) -> TreeModel:
    """A fitted ``pyspark.ml`` forest as arrays, from the nodes that it writes; as many rows as the model has nodes."""
    spark = SparkSession.active()
    path = f"{staging_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    thresholds: list[set[float]] = [set() for _ in columns]
    for r in nodes:
        if r.leftChild >= 0:
            thresholds[r.split.featureIndex].add(r.split.leftCategoriesOrThreshold[0])
    bins = T.Bins([np.array(sorted(t)) for t in thresholds])
    parts = []
    for _, group in itertools.groupby(nodes, key=lambda r: r.treeID):
        tree = list(group)
        # children stand side by side: nodes in the order in which they are met from the root
        order, place = [0], {0: 0}
        for i in order:
            if tree[i].leftChild >= 0:
                for child in (tree[i].leftChild, tree[i].rightChild):
                    place[child] = len(order)
                    order.append(child)
        inner = np.array([tree[i].leftChild >= 0 for i in order])
        feature = np.array([tree[i].split.featureIndex if k else -1 for i, k in zip(order, inner, strict=True)])
        cut = [
            int(np.searchsorted(bins.thresholds[f], tree[i].split.leftCategoriesOrThreshold[0])) if f >= 0 else -1
            for i, f in zip(order, feature, strict=True)
        ]
        left = np.array([place[tree[i].leftChild] if k else -1 for i, k in zip(order, inner, strict=True)])
        stats = np.array([list(tree[i].impurityStats) for i in order])
        parts.append(T.Trees(feature, np.array(cut), left, stats[:, 1] / stats.sum(axis=1), stats.sum(axis=1), np.zeros(1, int)))
    return TreeModel(columns, bins, T.joined(parts).scaled(1 / len(parts)), "identity")


def fit_forest(
    train: DataFrame, columns: list[str], label: str, max_depth: int = 10, n_estimators: int = 500, max_features: str = "sqrt", seed: int = 0
) -> TreeModel:
    """Random forest (MDL-2); P(1) is the mean share of ones in the leaves. ``pyspark.ml`` grows it where one task can't hold the cells."""
    table = CellTable.of(train, columns, label)
    sizes = table.bins.sizes
    if table.count <= IN_ONE_TASK:
        trees = table.in_one_task(lambda codes, n, ones: T.forest(codes, sizes, n, ones, max_depth, n_estimators, max_features, seed)[0])
        return TreeModel(columns, table.bins, trees.scaled(1 / n_estimators), "identity")
    forest = RandomForestClassifier(
        labelCol=label, maxDepth=max_depth, numTrees=n_estimators, seed=seed,
        featureSubsetStrategy={"auto": "sqrt"}.get(max_features, max_features),
    )
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(train.na.drop(subset=[*columns, label]))
    return flattened(forest.fit(rows), columns)
