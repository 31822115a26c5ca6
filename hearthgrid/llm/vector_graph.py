"""Approximate nearest neighbours by inner product: a robust-pruned directed graph per shard.

Different vectors are dealt to shards by their length, a quarter of an octave apart, and within that by hash to shards of
bounded size. One task builds the graph of a shard: points join in growing
batches, a greedy search over the graph so far proposes their neighbours, and relaxed distance pruning keeps edges
in diverse directions. Queries come in blocks of bounded size; one task runs a beam search of one
block in one shard. Vectors are lifted by one component to a common length, which makes the largest
inner product the smallest distance; vectors of similar length keep that component small, without which searches go astray.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthgrid.session import spread_out, stage

#: Vectors that a shard and queries that a block is laid out for.
SHARD, BLOCK = 4096, 2048
DEGREE, BEAM = 32, 96
#: A candidate is dropped if a kept neighbour is RELAX times nearer to it than the point itself is.
RELAX = 1.2
#: Points that join a graph at once.
BATCH = 512

#: Ranges of vector length for each doubling.
PER_OCTAVE = 4

INDEX = "dim int, size int, shard int, vectors array<array<double>>, members array<array<long>>, links array<array<int>>"
FOUND = "query_id long, variant int, vec_id long, score double"


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows times a power of two that brings their largest component below 1, and the exponents taken out."""
    exponents = np.frexp(np.abs(vectors).max(axis=1))[1]
    # two steps, as the factor itself may be out of range
    half = exponents // 2
    return np.ldexp(np.ldexp(vectors, -half[:, None]), (half - exponents)[:, None]), exponents


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one more component that gives all the same length, on a common scale."""
    exponent = int(np.frexp(np.abs(vectors).max())[1])
    vectors = np.ldexp(np.ldexp(vectors, -(exponent // 2)), exponent // 2 - exponent)
    norms = (vectors * vectors).sum(axis=1)
    return np.column_stack([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))]).astype(np.float32)


def beam_search(points: np.ndarray, links: np.ndarray, start: int, queries: np.ndarray, beam: int):
    """Ids and inner products of the best ``beam`` points met from ``start``, for each query; -1 where there are fewer."""
    n = len(queries)
    ids = np.full((n, beam), -1)
    dots = np.full((n, beam), -np.inf, np.float32)
    fresh = np.zeros((n, beam), bool)  # not yet expanded
    ids[:, 0], dots[:, 0], fresh[:, 0] = start, queries @ points[start], True
    seen = np.zeros((n, len(points)), bool)
    seen[:, start] = True
    while True:
        open_dots = np.where(fresh, dots, -np.inf)
        at = open_dots.argmax(axis=1)
        rows = np.flatnonzero(open_dots[np.arange(n), at] > -np.inf)
        if not len(rows):
            return ids, dots
        at = at[rows]
        fresh[rows, at] = False
        near = links[ids[rows, at]]
        new = (near >= 0) & ~seen[rows[:, None], near]
        seen[rows[:, None], np.where(near >= 0, near, start)] = True
        found = np.where(new, np.einsum("rd,rkd->rk", queries[rows], points[near]), -np.inf)
        all_ids = np.concatenate([ids[rows], near], axis=1)
        all_dots = np.concatenate([dots[rows], found], axis=1)
        all_fresh = np.concatenate([fresh[rows], new], axis=1)
        keep = np.argpartition(-all_dots, beam - 1, axis=1)[:, :beam]
        ids[rows], dots[rows], fresh[rows] = (np.take_along_axis(x, keep, 1) for x in (all_ids, all_dots, all_fresh))
        ids[rows] = np.where(np.isfinite(dots[rows]), ids[rows], -1)


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
    """At most ``degree`` diverse neighbours of each point in ``own``, nearest first; -1 fills up."""
    candidates = np.sort(candidates, axis=1)
    repeated = np.zeros(candidates.shape, bool)
    repeated[:, 1:] = candidates[:, 1:] == candidates[:, :-1]
    gone = (candidates < 0) | repeated | (candidates == own[:, None])
    x = points[candidates]
    length = (points[0] @ points[0])
    far = np.maximum(2 * length - 2 * np.einsum("rd,rkd->rk", points[own], x), 0)
    between = np.maximum(2 * length - 2 * np.matmul(x, x.transpose(0, 2, 1)), 0)
    out = np.full((len(own), degree), -1)
    row = np.arange(len(own))
    for k in range(degree):
        best = np.where(gone, np.inf, far).argmin(axis=1)
        left = ~gone[row, best]
        if not left.any():
            break
        out[left, k] = candidates[row, best][left]
        gone |= (RELAX**2 * between[row, best] <= far) & left[:, None]
        gone[row, best] = True
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, seed: int = 5) -> tuple[np.ndarray, int]:
    """Out-neighbours of every point (-1 fills up) and the point where searches start."""
    n = len(points)
    links = np.full((n, degree), -1)
    start = int((points @ points.mean(axis=0)).argmax())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    done = 1
    while done < n:
        batch = order[done : done + min(BATCH, done)]
        met, _ = beam_search(points, links, start, points[batch], beam)
        # points that join together may be neighbours too
        inner = points[batch] @ points[batch].T
        np.fill_diagonal(inner, -np.inf)
        mates = np.argsort(-inner, axis=1)[:, : min(degree, len(batch) - 1)]
        links[batch] = robust_prune(points, batch, np.concatenate([met, batch[mates]], axis=1), degree)
        source, target = np.repeat(batch, degree), links[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        # edges back, pruned where a point has too many
        by = np.argsort(target, kind="stable")
        ends, first, counts = np.unique(target[by], return_index=True, return_counts=True)
        for at in range(0, len(ends), BATCH):
            part = slice(at, at + BATCH)
            width = int(counts[part].max())
            back = np.full((len(ends[part]), width), -1)
            for r, (f, c) in enumerate(zip(first[part], counts[part], strict=True)):
                back[r, :c] = source[by[f : f + c]]
            both = np.concatenate([links[ends[part]], back], axis=1)
            pruned = robust_prune(points, ends[part], both, degree)
            full = (np.sort(both, axis=1) >= 0).sum(axis=1) > degree
            # with room for all, all stay
            roomy = -np.sort(-both, axis=1)[:, :degree]
            links[ends[part]] = np.where(full[:, None], pruned, _unique_rows(roomy))
        done += len(batch)
    return links, start


def _unique_rows(ids: np.ndarray) -> np.ndarray:
    """Rows in descending order with repeats replaced by -1."""
    out = ids.copy()
    out[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    return out


def _matrix(column: pa.ChunkedArray | pa.ListArray, dim: int) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy().reshape(-1, dim)


def build_shard(rows: pa.Table) -> pa.Table:
    """One row with the graph of a shard's vectors."""
    rows = rows.sort_by("first")
    dim = rows["dim"][0].as_py()
    vectors = _matrix(rows["embedding"], dim)
    links, start = build_graph(lifted(vectors))
    # the start comes first, so that a search finds it
    order = np.concatenate([[start], np.delete(np.arange(len(vectors)), start)])
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    links = np.where(links >= 0, place[links], -1)[order]
    members = rows["members"].to_pylist()
    return pa.table(
        {
            "dim": pa.array([dim], pa.int32()),
            "size": pa.array([rows["size"][0].as_py()], pa.int32()),
            "shard": pa.array([rows["shard"][0].as_py()], pa.int32()),
            "vectors": pa.array([list(vectors[order])], pa.list_(pa.list_(pa.float64()))),
            "members": pa.array([[members[i] for i in order]], pa.list_(pa.list_(pa.int64()))),
            "links": pa.array([list(links.astype(np.int32))], pa.list_(pa.list_(pa.int32()))),
        }
    )


def search_block(rows: pa.Table, k: int, beam: int) -> pa.Table:
    """The ``k`` best rows of a shard for each query of a block; a pair of shard and block is one row."""
    out: list[tuple] = []
    for r in range(rows.num_rows):
        dim = rows["dim"][r].as_py()
        vectors = _matrix(rows["vectors"][r].values, dim)
        members = rows["members"][r].as_py()
        links = np.array(rows["links"][r].as_py(), np.int64)
        queries = rows["queries"][r].values
        ids, turns = queries.field("vec_id").to_pylist(), queries.field("variant").to_pylist()
        wanted, wanted_at = scaled(_matrix(queries.field("embedding"), dim))
        points = lifted(vectors)
        vectors, vectors_at = scaled(vectors)
        asked = np.column_stack([wanted, np.zeros(len(wanted))]).astype(np.float32)
        met, _ = beam_search(points, links, 0, asked, max(beam, k + 1))
        for i, query_id in enumerate(ids):
            near = met[i][met[i] >= 0]
            # the product of the given vectors, also where a sum on the way would leave the range of a double
            with np.errstate(over="ignore", under="ignore"):
                score = np.ldexp(vectors[near] @ wanted[i], vectors_at[near] + wanted_at[i])
            # a vector with all its rows' ids: enough of the best vectors hold k other rows
            best = np.argsort(-score, kind="stable")[: k + 1]
            hits = [(-float(score[j]), v) for j in best for v in members[near[j]] if v != query_id]
            out += [(query_id, turns[i], v, -s) for s, v in sorted(hits)[:k]]
    columns = zip(*out, strict=True) if out else ([], [], [], [])
    types = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["query_id", "variant", "vec_id", "score"])


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding, dim`` without NULL ids, repeated rows, or vectors that are NULL, zero, or not finite."""
    as_double = F.col("embedding").cast("array<double>")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (
        vectors.select("vec_id", as_double.alias("embedding"))
        .where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda v: v != 0))
        .select("vec_id", "embedding", F.size("embedding").alias("dim"))
    )


def _looked_up(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for pair in sorted(table.items()) for v in pair]), key)


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, shard: int = SHARD, block: int = BLOCK, beam: int = BEAM
) -> DataFrame:
    """``query_id, rank, vec_id, score, variant``: the ``k`` rows with the largest inner product found for each query.

    Queries are the rows of ``vectors`` (``vec_id, embedding``) whose id is divisible by ``every``; candidates are all
    other rows of the same length of vector. Scores are inner products of the given vectors in double precision; ties go to the smaller
    id. Rows with a NULL id or a vector that is NULL, empty, zero or holds a NULL or non-finite component take no
    part; of finite ones any magnitude does (products beyond the range of a double are equal: zero or infinite). Repeated rows (same id and vector) count once. Different vectors with one id are
    different rows: as queries each has a ranking of its own, told apart by ``variant`` (from 1, in the order of the vectors; 1 where
    there is one), without the rows of its own id. An empty table gives an empty result; other columns are ignored.

    Rows with equal vectors are one point of the graph with the ``k + 1`` least of their ids, which is exact for the ``k`` best
    others and keeps a vector that a third of all rows share small. The only counts that reach the
    driver are those of vectors by number of components and range of length.
    """
    spark = vectors.sparkSession
    rows = usable(vectors).dropDuplicates(["vec_id", "embedding"])
    first_ids = Window.partitionBy("embedding").orderBy("vec_id")
    points = stage(
        rows.withColumn("n", F.row_number().over(first_ids))
        .where(F.col("n") <= k + 1)
        .groupBy("dim", "embedding")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("members")),
        "points",
    )
    variant = F.row_number().over(Window.partitionBy("vec_id").orderBy("embedding"))
    queries = rows.where(F.col("vec_id") % every == 0).withColumn("variant", variant)
    # length range of a vector; a unit vector is in the middle of one. Squares are taken of shares of the largest component
    largest = F.array_max(F.transform("embedding", F.abs))
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + (v / F.col("largest")) * (v / F.col("largest")))
    points = points.withColumn("largest", largest)
    size = F.floor((F.log2(squares) + 2 * F.log2("largest")) * (PER_OCTAVE / 2) + 0.5)
    points = points.withColumn("size", size.cast("int"))
    counts = points.groupBy("dim", "size").agg(F.count("*").alias("n")).collect()
    blocks = {r.dim: -(-r.n // block) for r in queries.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, variant int")
    shards = {f"{r.dim} {r['size']}": -(-r.n // shard) for r in counts}
    n_shards = _looked_up(shards, F.concat_ws(" ", "dim", "size"))
    n_blocks = _looked_up(blocks, F.col("dim"))
    dealt = points.where(F.col("dim").isin(*blocks)).select(
        "dim", "size", F.pmod(F.xxhash64("embedding"), n_shards).cast("int").alias("shard"),
        "embedding", "members", F.element_at("members", 1).alias("first"),
    )
    keys = ["dim", "size", "shard"]
    index = stage(spread_out(dealt, keys).groupBy(*keys).applyInArrow(build_shard, INDEX), "graph")
    asked = (
        queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "variant"), n_blocks).cast("int"))
        .groupBy("dim", "block")
        .agg(F.collect_list(F.struct("vec_id", "variant", "embedding")).alias("queries"))
    )
    # every block meets every shard of its vectors' number of components
    ranges = F.create_map(*[
        v for d in sorted(blocks)
        for v in (F.lit(d), F.array(*[F.struct(F.lit(r["size"]).alias("size"), F.lit(shards[f"{d} {r['size']}"]).alias("n"))
                                      for r in sorted(counts) if r.dim == d]))
    ])
    met = asked.select("*", F.explode(F.element_at(ranges, F.col("dim"))).alias("range")).select(
        "dim", "block", "queries", F.col("range.size").alias("size"),
        F.explode(F.sequence(F.lit(0), F.col("range.n") - 1)).alias("shard"),
    )
    held = index.select("*", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"))
    keys = [*keys, "block"]
    meetings = spread_out(held, keys).join(met, keys)
    found = meetings.groupBy(*keys).applyInArrow(lambda t: search_block(t, k, beam), FOUND)
    order = Window.partitionBy("query_id", "variant").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score", "variant")
    )
