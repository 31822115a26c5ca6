"""Running totals for groups too large for one task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthgrid.session import stage

# Ranges of values that are sorted apart from each other.
CHUNKS = 1024


def into_chunks(rows: DataFrame, keys: list[str], order: str, chunks: int = CHUNKS) -> DataFrame:
    """Rows with ``_chunk``, the range that ``order`` falls into, dealt by key and range.

    The ranges are cut at approximate quantiles of the values themselves, so each holds about
    ``1 / chunks`` of all rows, however the values are spread. One exchange serves the
    windows inside the chunks and the totals of the chunks.
    """
    rows = stage(rows, "values")
    shares = [i / chunks for i in range(1, chunks)]
    value = F.col(order).cast("double")
    cuts = rows.agg(F.percentile_approx(value, shares, 10 * chunks).alias("cuts")).first().cuts or []
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    if not cuts:
        return rows.withColumn("_chunk", F.lit(0)).repartition(*keys, "_chunk")
    numbered = Bucketizer(splits=splits, inputCol="_order", outputCol="_range").transform(
        rows.withColumn("_order", value)
    )
    return (
        numbered.withColumn("_chunk", F.col("_range").cast("int"))
        .drop("_order", "_range")
        .repartition(*keys, "_chunk")
    )


def _chunk_totals(chunked: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Totals per key and chunk with ``_b_<c>`` (earlier chunks) and ``<c>_total`` (whole key).

    One small row per key and chunk, so sorting them per key is cheap for any key.
    """
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = chunked.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    return totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_chunk").alias("_k_chunk"),
        *[f"_t_{c}" for c in sums],
        *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in sums],
        *[F.sum(f"_t_{c}").over(whole).alias(f"{c}_total") for c in sums],
    )


def _totals_inside(
    chunked: DataFrame, totals: DataFrame, keys: list[str], order: str, sums: list[str]
) -> DataFrame:
    """Join the chunk totals and add ``<c>_before``; chunks without a total are dropped."""
    match = F.col("_chunk").eqNullSafe(F.col("_k_chunk"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    columns = [c for c in chunked.columns if c != "_chunk"]
    return chunked.join(totals, match).select(
        *columns,
        *[
            (F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_b_{c}")).alias(f"{c}_before")
            for c in sums
        ],
        *[f"{c}_total" for c in sums],
    )


def running_totals(
    df: DataFrame, keys: list[str], order: str, sums: list[str], chunks: int = CHUNKS
) -> DataFrame:
    """Add ``<c>_before`` and ``<c>_total`` for each column of ``sums``.

    ``<c>_before`` is the total over all rows of the key with a smaller ``order`` value
    (which must be unique per key, and a number), ``<c>_total`` the total of the key. Rows are
    sorted inside one chunk only; the totals of earlier chunks come from a second, much
    smaller table, so no task ever sees a whole key.
    """
    chunked = into_chunks(df, keys, order, chunks)
    return _totals_inside(chunked, _chunk_totals(chunked, keys, sums), keys, order, sums)


def weighted_quantiles(
    counts: DataFrame, keys: list[str], value: str, n: str, probs: dict[str, float], chunks: int = CHUNKS
) -> DataFrame:
    """Exact, linearly interpolated quantiles from a value/count table (AGG-2).

    ``counts`` has one row per key and distinct value. The chunk totals tell which chunks
    hold the wanted ranks; only those are sorted. The value at rank r is the one whose
    count interval covers r.
    """
    chunked = into_chunks(counts, keys, value, chunks)
    totals = _chunk_totals(chunked, keys, [n])
    total = F.col(f"{n}_total")
    ranks = {
        f"_{name}_{side}": cut((total - 1) * F.lit(p))
        for name, p in probs.items()
        for side, cut in (("lo", F.floor), ("hi", F.ceil))
    }
    covers = lambda rank, before, size: (before <= rank) & (rank < before + size)
    wanted = F.lit(False)
    for rank in ranks.values():
        wanted = wanted | covers(rank, F.col(f"_b_{n}"), F.col(f"_t_{n}"))
    ranked = _totals_inside(chunked, totals.where(wanted), keys, value, [n])
    out = ranked.groupBy(*keys, f"{n}_total").agg(
        *[
            F.max(F.when(covers(rank, F.col(f"{n}_before"), F.col(n)), F.col(value))).alias(name)
            for name, rank in ranks.items()
        ]
    )
    cols = []
    for name, p in probs.items():
        pos = (total - 1) * F.lit(p)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return out.select(*keys, total.alias("n"), *cols)
