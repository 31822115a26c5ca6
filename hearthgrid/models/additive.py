"""Additive models of boosted shape functions and pair interactions (MDL-6, XAI-11).

Each feature has a step function over its bins. Boosting goes round the features, one at a time: sums of gradients by bin give a small
tree on that feature, which is added to its function at a low rate. Pairs of features follow in the same way, on tables of coarse bins;
they are the pairs whose residual gradients gain most by one cut in each of the two.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from hearthgrid.models import cells
from hearthgrid.models import trees as T

ROUNDS, RATE = 100, 0.1
#: Squared penalty on values, and the least sum of second derivatives on a side of a cut.
PENALTY, LEAST = 1.0, 1.0
INTERACTIONS = 10
COARSE = 8


@dataclass
class Shapes:
    """``terms``: the features of each term (one or two); ``tables``: its values by bins; ``coarse``: coarse bin of each bin of a feature."""

    sizes: np.ndarray
    coarse: list[np.ndarray]
    intercept: float = 0.0
    terms: list[tuple[int, ...]] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)

    def slots(self, term: tuple[int, ...], codes: np.ndarray, width: int | None = None) -> np.ndarray:
        """Place of each row in the term's table; ``width`` is that of a pair's table if it is wider than its bins."""
        if len(term) == 1:
            return codes[:, term[0]]
        i, j = term
        return self.coarse[i][codes[:, i]] * (width or self.width(j)) + self.coarse[j][codes[:, j]]

    def width(self, feature: int) -> int:
        return int(self.coarse[feature].max()) + 1

    def shape(self, term: tuple[int, ...]) -> tuple[int, ...]:
        return (int(self.sizes[term[0]]),) if len(term) == 1 else tuple(self.width(f) for f in term)

    def parts(self, codes: np.ndarray) -> np.ndarray:
        """Contribution of each term (columns) to each row."""
        return np.column_stack([t.ravel()[self.slots(term, codes)] for term, t in zip(self.terms, self.tables, strict=True)])

    def margins(self, codes: np.ndarray) -> np.ndarray:
        return self.intercept + (self.parts(codes).sum(axis=1) if self.terms else np.zeros(len(codes)))


#: One term of each of several models side by side; None where a model has no such term.
Terms = tuple[tuple[int, ...] | None, ...]


class HeldCells:
    """Cells of several models in one task; sums by bin of the derivatives of the loss at the present models.

    ``n, ones`` (model, cell) are the training rows of each model, which works on the cells that it has rows in.
    """

    def __init__(self, codes: np.ndarray, n: np.ndarray, ones: np.ndarray, shapes: list[Shapes]) -> None:
        self.codes, self.shapes = codes, shapes
        self.model, self.cell = np.nonzero(n)
        self.n, self.ones = n[self.model, self.cell], ones[self.model, self.cell]
        self.margin = np.concatenate([s.margins(codes[np.flatnonzero(row)]) for s, row in zip(shapes, n, strict=True)])
        self.places: dict[Terms, np.ndarray] = {}

    def place(self, terms: Terms) -> np.ndarray:
        """Place of each cell of each model in the tables of its term, which stand one after the other."""
        width = int(np.prod(table_shape(self.shapes, terms)))
        single = next(t for t in terms if t is not None)
        if len(single) == 1:
            return self.codes[self.cell, single[0]] + self.model * width
        out = np.empty(len(self.model), np.int64)
        ends = np.searchsorted(self.model, np.arange(len(terms) + 1))
        for k, (term, s) in enumerate(zip(terms, self.shapes, strict=True)):
            own = slice(ends[k], ends[k + 1])
            # the tables of pairs are as wide as they may get
            out[own] = k * width + (s.slots(term, self.codes[self.cell[own]], COARSE) if term else 0)
        return out

    def derivatives(self) -> tuple[np.ndarray, np.ndarray]:
        p = T.logistic(self.margin)
        weighted = self.n * p
        return weighted - self.ones, weighted * (1 - p)

    def sums(self, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
        """Sums ``g, h`` (model, bin) or (model, coarse bin, coarse bin)."""
        if terms not in self.places:
            self.places[terms] = self.place(terms)
        return self.counted(self.places[terms], terms, self.derivatives())

    def counted(self, place: np.ndarray, terms: Terms, weights: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(terms), *table_shape(self.shapes, terms))
        return tuple(np.bincount(place, w, int(np.prod(shape))).reshape(shape) for w in weights)

    def moved(self, terms: Terms, step: np.ndarray) -> None:
        self.margin += step.ravel()[self.places[terms]]

    def pair_sums(self, pairs: list[Terms]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        weights = self.derivatives()
        return (self.counted(self.place(p), p, weights) for p in pairs)


class SpreadCells:
    """The same for one model over a table of cells: each call is one aggregate, combined in each task first, of as many rows as there are bins."""

    def __init__(self, rows: DataFrame, shapes: Shapes) -> None:
        self.rows, self.shapes = rows, shapes

    def pair_sums(self, pairs: list[Terms]) -> list[tuple[np.ndarray, np.ndarray]]:
        shapes, width, tables = self.shapes, len(self.shapes.sizes), [table_shape([self.shapes], p) for p in pairs]
        counts, terms = [int(np.prod(t)) for t in tables], [t for (t,) in pairs]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = [np.zeros((2, c)) for c in counts]
            for batch in batches:
                if batch.num_rows:
                    codes, n, ones, _ = cells.unpacked(batch, width)
                    p = T.logistic(shapes.margins(codes))
                    for term, total in zip(terms, totals, strict=True):
                        at = shapes.slots(term, codes, COARSE)
                        for row, w in zip(total, (n * p - ones, n * p * (1 - p)), strict=True):
                            row += np.bincount(at, w, len(row))
            for k, total in enumerate(totals):
                slot = np.arange(total.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(slot), k, np.int32)), pa.array(slot), pa.array(total[0]), pa.array(total[1])],
                    names=["term", "slot", "g", "h"],
                )

        partial = self.rows.mapInArrow(run, "term int, slot int, g double, h double")
        found = partial.groupBy("term", "slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        term, slot, g, h = (found[c].to_numpy() for c in ("term", "slot", "g", "h"))
        out = []
        for k, (table, count) in enumerate(zip(tables, counts, strict=True)):
            both = np.zeros((2, count))
            both[0, slot[term == k]], both[1, slot[term == k]] = g[term == k], h[term == k]
            out.append(tuple(b.reshape(1, *table) for b in both))
        return out

    def sums(self, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
        return self.pair_sums([terms])[0]

    def moved(self, terms: Terms, step: np.ndarray) -> None:
        """Margins are taken from the model at every call."""


def table_shape(shapes: list[Shapes], terms: Terms) -> tuple[int, ...]:
    """Shape of the tables of a term of several models; those of a pair have room for all coarse bins."""
    term = next(t for t in terms if t is not None)
    return (int(shapes[0].sizes[term[0]]),) if len(term) == 1 else (COARSE, COARSE)


def cuts(g: np.ndarray, h: np.ndarray, all_g: np.ndarray, all_h: np.ndarray) -> np.ndarray:
    """Gain of each cut after a bin, but for the quality of the whole; 0 where a side is too light. ``g, h``: sums up to the bin."""
    right_g, right_h = all_g - g, all_h - h
    gain = g**2 / (h + PENALTY) + right_g**2 / (right_h + PENALTY)
    gain[(h < LEAST) | (right_h < LEAST)] = 0
    return gain


def line_steps(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values (model, bin) of a tree of depth 2 on one feature, of several models."""
    models, size = g.shape
    if size == 1:
        return -g / (h + PENALTY)
    bins, line = np.arange(size), np.arange(models)
    low_g, low_h = g.cumsum(axis=1), h.cumsum(axis=1)
    all_g, all_h = low_g[:, -1], low_h[:, -1]
    gain = cuts(low_g[:, :-1], low_h[:, :-1], all_g[:, None], all_h[:, None])
    at = gain.argmax(axis=1)
    parted = gain[line, at] - all_g**2 / (all_h + PENALTY) > 1e-9
    leaf = np.zeros((models, size), np.int64)
    if size > 2 and parted.any():
        # sums of the part to the right begin at its first bin
        left = bins <= at[:, None]
        ends = [low_g[line, at], low_h[line, at]]
        upper_g, upper_h = (np.where(left, 0.0, w).cumsum(axis=1) for w in (g, h))
        whole = [np.where(left, e[:, None], u[:, -1:]) for e, u in zip(ends, (upper_g, upper_h), strict=True)]
        gain = cuts(np.where(left, low_g, upper_g), np.where(left, low_h, upper_h), *whole)
        for side, within, total_g, total_h in (
            (0, bins < at[:, None], *ends), (2, (bins > at[:, None]) & (bins < size - 1), upper_g[:, -1], upper_h[:, -1]),
        ):
            part = np.where(within, gain, -np.inf)
            cut = part.argmax(axis=1)
            again = parted & (part[line, cut] - total_g**2 / (total_h + PENALTY) > 1e-9)
            own = ~left if side else left
            leaf += own * (side + (again[:, None] & (bins > cut[:, None])))
        leaf *= parted[:, None]
    else:
        leaf += 2 * (parted[:, None] & (bins > at[:, None]))
    leaf += 4 * line[:, None]
    sums_g, sums_h = (np.bincount(leaf.ravel(), w.ravel(), 4 * models) for w in (g, h))
    return (-sums_g / (sums_h + PENALTY))[leaf]


def quadrants(g: np.ndarray, h: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gain and values (model, bin, bin) of the best cut of a table of two features into four parts, of several models.

    ``shapes`` (model, 2) are the numbers of bins that a model has; no gain where there is no cut.
    """
    line, (high, wide) = np.arange(len(g)), g.shape[1:]
    if min(high, wide) < 2:
        return np.zeros(len(g)), np.zeros(g.shape)
    low = np.stack([g, h]).cumsum(axis=2).cumsum(axis=3)
    inner, right, bottom, every = low[:, :, :-1, :-1], low[:, :, :-1, -1:], low[:, :, -1:, :-1], low[:, :, -1:, -1:]
    corners = np.stack([inner, right - inner, bottom - inner, every - right - bottom + inner])
    gain = (corners[:, 0] ** 2 / (corners[:, 1] + PENALTY)).sum(axis=0) - every[0] ** 2 / (every[1] + PENALTY)
    inside = (np.arange(high - 1)[:, None] < shapes[:, 0, None, None] - 1) & (np.arange(wide - 1) < shapes[:, 1, None, None] - 1)
    flat = np.where(inside, gain, -np.inf).reshape(len(g), -1)
    at = flat.argmax(axis=1)
    i, j = at // (wide - 1), at % (wide - 1)
    values = -corners[:, 0, line, i, j] / (corners[:, 1, line, i, j] + PENALTY)
    part = 2 * (np.arange(high)[:, None] > i[:, None, None]) + (np.arange(wide) > j[:, None, None])
    cut = shapes.min(axis=1) > 1
    return np.where(cut, flat[line, at], 0.0), np.where(cut[:, None, None], values[part, line[:, None, None]], 0.0)


def boost(held: HeldCells | SpreadCells, shapes: list[Shapes], rounds: int = ROUNDS, interactions: int = INTERACTIONS) -> list[Shapes]:
    """Boost the functions of all features in turn, then the tables of the strongest pairs, of several models side by side."""
    models, width = len(shapes), len(shapes[0].sizes)

    def add(every: list[Terms], step_of: Callable[[Terms, np.ndarray, np.ndarray], np.ndarray]) -> None:
        tables = [np.zeros((models, *table_shape(shapes, terms))) for terms in every]
        for terms, table in zip(every, tables, strict=True):
            for s, term, own in zip(shapes, terms, table, strict=True):
                if term is not None:
                    s.terms.append(term)
                    s.tables.append(own[tuple(map(slice, s.shape(term)))])  # sees each step
        for _ in range(rounds):
            for terms, table in zip(every, tables, strict=True):
                step = RATE * step_of(terms, *held.sums(terms))
                table += step
                held.moved(terms, step)

    add([((f,),) * models for f in range(width)], lambda _, g, h: line_steps(g, h))
    pairs = list(itertools.combinations(range(width), 2)) if interactions else []
    bins = np.array([[s.width(f) for f in range(width)] for s in shapes])
    found = [quadrants(*sums, bins[:, list(p)])[0] for p, sums in zip(pairs, held.pair_sums([(p,) * models for p in pairs]), strict=True)] if pairs else []
    chosen = []
    for k in range(models):
        order = sorted(range(len(pairs)), key=lambda p, k=k: (-found[p][k], pairs[p]))[:interactions]
        chosen.append([pairs[p] for p in order if found[p][k] > 1e-9])
    ranks = list(itertools.zip_longest(*chosen))
    if ranks:
        # a model without the term has tables of one bin, which no cut parts
        sizes = {terms: np.array([bins[k, list(t)] if t else (1, 1) for k, t in enumerate(terms)]) for terms in ranks}
        add(ranks, lambda terms, g, h: quadrants(g, h, sizes[terms])[1])
    return shapes


def start(sizes: np.ndarray, counts: list[np.ndarray], n: float, ones: float) -> Shapes:
    """Model without terms: the log odds of all rows, and coarse bins of about equal numbers of rows (``counts`` by bin)."""
    coarse = []
    for c in counts:
        share = (np.cumsum(c) - c / 2) / max(c.sum(), 1)
        coarse.append(np.unique(np.minimum((share * COARSE).astype(int), COARSE - 1), return_inverse=True)[1].reshape(-1))
    return Shapes(np.asarray(sizes), coarse, 2 * float(T.half_log_odds(np.array(ones / n if n else 0.5))))


def centred(shapes: Shapes, codes: np.ndarray, n: np.ndarray) -> Shapes:
    """The same scores with terms of mean zero over the rows."""
    total = n.sum()
    for k, term in enumerate(shapes.terms):
        mean = float(shapes.tables[k].ravel()[shapes.slots(term, codes)] @ n / total)
        shapes.tables[k] = shapes.tables[k] - mean
        shapes.intercept += mean
    return shapes


def fit_side_by_side(codes: np.ndarray, sizes: np.ndarray, n: np.ndarray, ones: np.ndarray, rounds: int = ROUNDS,
                     interactions: int = INTERACTIONS) -> list[Shapes]:
    """Fit a model on each line of ``n, ones`` (model, cell) in one task; each step is taken in all models at once."""
    shapes = [start(sizes, [np.bincount(codes[:, f], w, s) for f, s in enumerate(sizes)], w.sum(), o.sum()) for w, o in zip(n, ones, strict=True)]
    boost(HeldCells(codes, n, ones, shapes), shapes, rounds, interactions)
    return [centred(s, codes, w) for s, w in zip(shapes, n, strict=True)]


def fit_cells(codes: np.ndarray, sizes: np.ndarray, n: np.ndarray, ones: np.ndarray, rounds: int = ROUNDS,
              interactions: int = INTERACTIONS) -> Shapes:
    """Fit on cells in one task."""
    return fit_side_by_side(codes, sizes, n[None], ones[None], rounds, interactions)[0]


def fit_table(table: cells.CellTable, rounds: int = ROUNDS, interactions: int = INTERACTIONS) -> Shapes:
    """Fit over all tasks: one aggregate for each step, of as many rows as a term has bins."""
    sizes, width = table.bins.sizes, len(table.bins.thresholds)
    flat = Shapes(sizes, [np.zeros(s, int) for s in sizes])
    # at probability 1/2 the second derivatives are a quarter of the rows
    counted = SpreadCells(table.rows, flat).pair_sums([((f,),) for f in range(width)])
    g, h = counted[0]
    n = 4 * h.sum()
    shapes = start(sizes, [4 * b[0] for _, b in counted], n, n / 2 - g.sum())
    return boost(SpreadCells(table.rows, shapes), [shapes], rounds, interactions)[0]


@dataclass
class AdditiveModel:
    """Fitted shape functions over named features."""

    columns: list[str]
    bins: T.Bins
    shapes: Shapes

    def names(self) -> list[str]:
        """Names of the terms; a pair is joined by ``x``."""
        return [" x ".join(self.columns[f] for f in term) for term in self.shapes.terms]

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with P(1) as column ``p``, NULL where a feature is not known."""

        @F.pandas_udf("double")
        def p(*features: pd.Series) -> pd.Series:
            x = np.column_stack([f.to_numpy(float) for f in features])
            out = np.full(len(x), np.nan)
            known = ~np.isnan(x).any(axis=1)
            out[known] = T.logistic(self.shapes.margins(self.bins.codes(x[known])))
            return pd.Series(out)

        out = df.select(*df.columns, p(*[F.col(c).cast("double") for c in self.columns]).alias("p"))
        return out.withColumn("p", F.nanvl("p", F.lit(None)))

    def contributions(self, df: DataFrame, ids: list[str]) -> DataFrame:
        """``ids, feature, value, contribution`` of every term; a pair has no value. Rows with an unknown feature are left out."""
        terms, names, width = self.shapes.terms, self.names(), len(self.columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[-width:]])
                parts = self.shapes.parts(self.bins.codes(x))
                values = np.column_stack([x[:, t[0]] if len(t) == 1 else np.full(len(x), np.nan) for t in terms])
                repeat = pa.array(np.repeat(np.arange(len(x)), len(terms)))
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(repeat) for c in batch.columns[: len(ids)]), pa.array(names * len(x)),
                     pa.array(values.ravel(), from_pandas=True), pa.array(parts.ravel())],
                    names=[*ids, "feature", "value", "contribution"],
                )

        known = df.select(*ids, *[F.col(c).cast("double").alias(f"_{j}") for j, c in enumerate(self.columns)])
        known = known.na.drop(subset=[f"_{j}" for j in range(width)])
        schema = ST.StructType(
            [known.schema[c] for c in ids]
            + [ST.StructField("feature", ST.StringType()), ST.StructField("value", ST.DoubleType()),
               ST.StructField("contribution", ST.DoubleType())]
        )
        return known.mapInArrow(run, schema)

    def table(self) -> list[tuple]:
        """``feature, bin, lower, upper, other_bin, weight`` of every bin of every term; the outer bins are open."""
        rows = []
        for term, name, values in zip(self.shapes.terms, self.names(), self.shapes.tables, strict=True):
            for at in np.ndindex(values.shape):
                lower = upper = other = None
                if len(term) == 1:
                    cuts = self.bins.thresholds[term[0]]
                    lower = float(cuts[at[0] - 1]) if at[0] else None
                    upper = float(cuts[at[0]]) if at[0] < len(cuts) else None
                else:
                    other = int(at[1])
                rows.append((name, int(at[0]), lower, upper, other, float(values[at])))
        return rows


def fit_additive(
    train: DataFrame, columns: list[str], label: str, bins: int = 64, rounds: int = ROUNDS, interactions: int = INTERACTIONS
) -> AdditiveModel:
    """Additive model of boosted shape functions with pair interactions (MDL-6)."""
    table = cells.CellTable.of(train, columns, label, cells.bins_of(train, columns, bins))
    sizes = table.bins.sizes
    if table.count > cells.IN_ONE_TASK:
        shapes = fit_table(table, rounds, interactions)
    else:
        shapes = table.in_one_task(lambda codes, n, ones: fit_cells(codes, sizes, n, ones, rounds, interactions))
    return AdditiveModel(columns, table.bins, shapes)
