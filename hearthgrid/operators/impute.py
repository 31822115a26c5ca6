"""Nearest-neighbour imputation (CLN-4)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthgrid.config import IMPUTE_NEIGHBOURS
from hearthgrid.session import spread_out, stage

# Donors that a bucket is laid out for, buckets of all kinds of donors at most, and receivers that are compared at once.
BUCKET, MOST_BUCKETS, BLOCK = 64, 10_000, 256

_COLUMN, _DONOR = "_column", "_donor"


class _Plan:
    """Which donors may fill the gaps of which rows, and the buckets that they lie in.

    A kind of row is the set of its known columns (a bit for each). For receivers of kind ``have`` and donors of kind ``d`` the
    shared column that spreads widest is the pivot: the distance is at least the scaled difference in it.
    """

    def __init__(self, width: int, spread: list[float], receivers: list[int], donors: dict[int, int], size: int) -> None:
        self.width, self.size = width, max(size, -(-sum(donors.values()) // MOST_BUCKETS))
        order = sorted(range(width), key=lambda j: (-spread[j], j))
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        for have in receivers:
            # a donor helps that shares a column and has one that is missing
            fits = [d for d in sorted(donors) if have & d and d & ~have]
            self.pairs[have] = [(d, next(j for j in order if have & d & 1 << j)) for d in fits]
        self.used = sorted({pair for pairs in self.pairs.values() for pair in pairs})
        self.counts = donors
        self.cuts: dict[tuple[int, int], np.ndarray] = {}

    def shares(self, kind: int, pivot: int) -> list[float]:
        """Shares of the donors at which their buckets are cut."""
        n = -(-self.counts[kind] // self.size)
        return [i / n for i in range(1, n)]

    def scale(self, have: int, kind: int) -> float:
        """Factor from the difference in one column to the least distance."""
        return math.sqrt(self.width / (have & kind).bit_count())


def _dealt_donors(plan: _Plan, names: list[str]):
    """Donors by kind, pivot and bucket."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for kind, pivot in plan.used:
                own = rows[rows["_kind"] == kind]
                if len(own):
                    at = np.searchsorted(plan.cuts[kind, pivot], own[names[pivot]].to_numpy(float), "right")
                    yield own.assign(_d=kind, _p=pivot, _bucket=at.astype(np.int32))[["_d", "_p", "_bucket", "_id", *names]]

    return run


def _dealt_receivers(plan: _Plan, names: list[str], first: bool):
    """Rows with a gap at their home buckets, or at all others within their radius."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for have, own in rows.groupby("_kind"):
                for kind, pivot in plan.pairs[int(have)]:
                    cuts, value = plan.cuts[kind, pivot], own[names[pivot]].to_numpy(float)
                    home = np.searchsorted(cuts, value, "right")
                    if first:
                        yield own.assign(_d=kind, _p=pivot, _bucket=home.astype(np.int32), _radius=np.inf)[_VISIT + names]
                        continue
                    # a little wider than the bound, for rounding
                    reach = own["_radius"].to_numpy(float) / plan.scale(int(have), kind) * (1 + 1e-9)
                    low, high = np.searchsorted(cuts, value - reach, "left"), np.searchsorted(cuts, value + reach, "right")
                    repeat = np.repeat(np.arange(len(own)), high - low + 1)
                    bucket = np.concatenate([np.arange(a, b + 1) for a, b in zip(low, high, strict=True)])
                    away = bucket != home[repeat]
                    out = own.iloc[repeat[away]].assign(_d=kind, _p=pivot, _bucket=bucket[away].astype(np.int32), _radius=reach[repeat[away]])
                    yield out[_VISIT + names]

    return run


_VISIT = ["_d", "_p", "_bucket", "_kind", "_id", "_radius"]


def _nearest(names: list[str], k: int, counter):
    """The k nearest donors of a bucket for each visiting row and missing column."""

    def search(visits: pd.DataFrame, donors: pd.DataFrame) -> pd.DataFrame:
        out, compared = [], 0
        if len(visits) and len(donors):
            kind, pivot = int(visits["_d"].iloc[0]), names[int(visits["_p"].iloc[0])]
            donors = donors.sort_values([pivot, "_id"], kind="stable")
            b, ids, sorted_by = donors[names].to_numpy(float), donors["_id"].to_numpy(), donors[pivot].to_numpy(float)
            visits = visits.sort_values(pivot, kind="stable")
            for start in range(0, len(visits), BLOCK):
                block = visits.iloc[start : start + BLOCK]
                value, radius = block[pivot].to_numpy(float), block["_radius"].to_numpy(float)
                # the donors that any row of the block may need
                low, high = np.searchsorted(sorted_by, (value - radius).min(), "left"), np.searchsorted(sorted_by, (value + radius).max(), "right")
                if low == high:
                    continue
                a, near_b, near_ids = block[names].to_numpy(float), b[low:high], ids[low:high]
                own = block["_id"].to_numpy()
                compared += len(a) * len(near_b)
                shared = ~np.isnan(a[:, None, :]) & ~np.isnan(near_b[None])
                difference = np.where(shared, a[:, None, :] - near_b[None], 0.0)
                total, count = np.zeros(shared.shape[:2]), shared.sum(axis=2)
                for j in range(len(names)):
                    total += difference[:, :, j] ** 2
                distance = np.sqrt(total * len(names) / np.maximum(count, 1))
                for j, name in enumerate(names):
                    if not kind >> j & 1:
                        continue
                    rows = np.flatnonzero(np.isnan(a[:, j]))
                    # of equal distances the smaller id
                    best = np.lexsort((np.broadcast_to(near_ids, (len(rows), len(near_ids))), distance[rows]))[:, :k]
                    r, c = np.indices(best.shape)
                    at = best[r, c].ravel()
                    out.append(pd.DataFrame({
                        "_id": own[rows[r.ravel()]], _COLUMN: name, _DONOR: near_ids[at],
                        "_dist": distance[rows[r.ravel()], at], "_value": near_b[at, j],
                    }))
        if counter is not None:
            counter.add(compared)
        columns = ["_id", _COLUMN, _DONOR, "_dist", "_value"]
        return pd.concat(out)[columns] if out else pd.DataFrame([], columns=columns)

    return search


def knn_impute(
    df: DataFrame, id_col: str, columns: list[str], k: int = IMPUTE_NEIGHBOURS, bucket: int = BUCKET, counter=None
) -> DataFrame:
    """Fill each missing cell by the distance-weighted mean of its k nearest rows.

    Distance is euclidean over the columns both rows have, scaled up for the missing
    ones. Rows at distance 0 decide alone; without any comparable row the column mean
    is used. Ties go to the smaller ``id_col``.

    Donors lie in buckets by the columns that they have and the values of one of them. A row with a gap first searches the buckets that
    its own values fall into; the k-th distance found there bounds how far the values of a nearer donor can be, and only
    buckets within that bound are searched after. Exact for any number of rows; ``counter`` (an accumulator) counts the distances.
    The driver gets the sets of known columns and at most ``MOST_BUCKETS`` cuts for each.
    """
    columns = list(columns)
    bits = F.lit(0)
    for j, c in enumerate(columns):
        bits = bits + F.when(F.col(c).isNotNull(), 1 << j).otherwise(0)
    values = [F.col(c).cast("double").alias(c) for c in columns]
    rows = stage(df.select(F.col(id_col).alias("_id"), *values, bits.alias("_kind")), "impute")
    full = (1 << len(columns)) - 1
    kinds = {r["_kind"]: r["n"] for r in rows.groupBy("_kind").agg(F.count("*").alias("n")).collect()}
    spread = rows.agg(*[F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(c) for c in columns]).first()
    plan = _Plan(len(columns), list(spread), [h for h in kinds if h != full], {d: n for d, n in kinds.items() if d}, bucket)
    cut = {pair: plan.shares(*pair) for pair in plan.used}
    found = [
        F.percentile_approx(F.when(F.col("_kind") == kind, F.col(columns[p])), shares, 100_000).alias(f"{kind} {p}")
        for (kind, p), shares in cut.items() if shares
    ]
    cuts = rows.agg(*found).first().asDict() if found else {}
    plan.cuts = {(d, p): np.unique(cuts.get(f"{d} {p}") or []).astype(float) for d, p in plan.used}

    id_type, double = rows.schema["_id"].dataType, T.DoubleType()
    fields = [T.StructField(c, double) for c in columns]
    place = [T.StructField(c, T.IntegerType()) for c in ("_d", "_p", "_bucket")]
    one_id = T.StructField("_id", id_type)
    donors = rows.where("_kind > 0").mapInPandas(_dealt_donors(plan, columns), T.StructType([*place, one_id, *fields]))
    visit = T.StructType([*place, T.StructField("_kind", T.IntegerType()), one_id, T.StructField("_radius", double), *fields])
    result = T.StructType([one_id, T.StructField(_COLUMN, T.StringType()), T.StructField(_DONOR, id_type),
                           T.StructField("_dist", double), T.StructField("_value", double)])
    keys = ["_d", "_p", "_bucket"]

    def searched(visits: DataFrame) -> DataFrame:
        both = spread_out(visits, keys).groupBy(*keys).cogroup(spread_out(donors, keys).groupBy(*keys))
        return both.applyInPandas(_nearest(columns, k, counter), result)

    nearest = Window.partitionBy("_id", _COLUMN).orderBy("_dist", _DONOR)

    def best(candidates: DataFrame) -> DataFrame:
        return candidates.withColumn("_rank", F.row_number().over(nearest)).where(F.col("_rank") <= k)

    gaps = rows.where(F.col("_kind") != full)
    at_home = stage(best(searched(gaps.mapInPandas(_dealt_receivers(plan, columns, True), visit))), "nearest-at-home")
    # without k donors for each missing column every bucket is searched
    kth = at_home.groupBy("_id", _COLUMN).agg(F.max(F.when(F.col("_rank") == k, F.col("_dist"))).alias("_kth"))
    missing = F.lit(len(columns)) - F.bit_count("_kind")
    reached = kth.groupBy("_id").agg(F.max("_kth").alias("_most"), F.count("_kth").alias("_full"))
    radius = F.when(F.col("_full") == missing, F.col("_most")).otherwise(float("inf"))
    wider = gaps.join(reached, "_id", "left").withColumn("_radius", F.coalesce(radius, F.lit(float("inf"))))
    away = searched(wider.mapInPandas(_dealt_receivers(plan, columns, False), visit))
    kept = best(at_home.drop("_rank").unionByName(away))

    weight = F.when(F.col("_dist") > 0, 1 / F.nullif(F.col("_dist"), F.lit(0.0)))
    fills = kept.groupBy("_id", _COLUMN).agg(
        F.when(F.min("_dist") == 0, F.avg(F.when(F.col("_dist") == 0, F.col("_value"))))
        .otherwise(F.sum(F.col("_value") * weight) / F.sum(weight))
        .alias("_fill")
    )
    wide = fills.groupBy("_id").agg(
        *[F.max(F.when(F.col(_COLUMN) == c, F.col("_fill"))).alias(f"_f_{c}") for c in columns]
    )
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return (
        df.join(wide, df[id_col] == wide["_id"], "left")
        .withColumns(
            {
                c: F.coalesce(F.col(c), F.col(f"_f_{c}"), F.lit(means[c]).cast("double"))
                for c in columns
            }
        )
        .select(*df.columns)
    )
