"""SimHash near-duplicates by vantage-point trees.

Different fingerprints are dealt to shards by a tree of vantage points: a fingerprint nearer to a node's point than its
radius goes inside, any other outside. A pair within ``RADIUS`` bits that a node parts has its outer end within
``radius + RADIUS`` of the point (triangle inequality), so outer fingerprints in that belt
visit the inner side too, and go down it to every shard that may hold a partner. Inside a
shard the same recursion prunes the comparison down to small blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgrid.llm.common import map_rows
from hearthgrid.llm.graph import star_components
from hearthgrid.session import spread_out, stage

#: Fingerprints at most this many bits apart are linked.
RADIUS = 3
SHINGLE = 3
#: Fingerprints that a shard is laid out for.
SHARD = 32_768
#: The tree is laid out on a sample of this many fingerprints for each shard, and at most so many in all.
SAMPLE, MAX_SAMPLE = 64, 1 << 20
BLOCK = 1024
NO_ID = (1 << 63) - 1  # stands for a NULL id, after all others

PRINTS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("print", pa.int64())])


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of a text's 3-word shingles; zero without words."""
    # lower() and split() of bytes know ASCII letters and the six white-space characters only
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    votes, total = np.zeros(64, np.int64), max(1, len(words) - SHINGLE + 1)
    for at in range(0, total, 1 << 16):  # bounded memory for very long texts
        if len(words) < SHINGLE:
            shingles = [b" ".join(words)]
        else:
            part = words[at : at + (1 << 16) + SHINGLE - 1]
            shingles = map(b" ".join, zip(part, part[1:], part[2:], strict=False))
        hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, print`` of every row."""
    return map_rows(
        docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"),
        lambda ids, keys, texts: zip(ids, keys, map(fingerprint, texts), strict=True),
        PRINTS,
        rows=100_000,
    )


def distance(point: np.uint64, prints: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints ^ point).astype(np.int16)


def split(sample: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point and radius that part ``sample`` about evenly with the thinnest belt, or None."""
    best = None
    for point in sample[:: max(1, len(sample) // 8)][:8]:
        d = distance(point, sample)
        for radius in set(np.quantile(d, [0.35, 0.5, 0.65], method="nearest").tolist()):
            inside = np.count_nonzero(d < radius)
            if 0.25 * len(d) <= inside <= 0.75 * len(d):
                belt = np.count_nonzero((d >= radius) & (d < radius + RADIUS)) / len(d)
                if best is None or belt < best[0]:
                    best = belt, point, int(radius)
    return best and best[1:]


def lay_out(sample: np.ndarray, shards: int, first: int = 0):
    """Nested ``(point, radius, inside, outside)`` whose ends are shard numbers; also the next free number."""
    cut = split(sample) if shards > 1 and len(sample) > 4 else None
    if cut is None:
        return first, first + 1
    inner = distance(cut[0], sample) < cut[1]
    inside, after = lay_out(sample[inner], max(1, round(shards * inner.mean())), first)
    outside, after = lay_out(sample[~inner], max(1, round(shards * (1 - inner.mean()))), after)
    return (int(cut[0]), cut[1], inside, outside), after


def route(tree, prints: np.ndarray, home: np.ndarray, visiting: np.ndarray):
    """Yield ``shard, positions, at_home`` of those that live in or visit each shard."""
    if not len(home) and not len(visiting):
        return
    if not isinstance(tree, tuple):
        for at, lives in ((home, True), (visiting, False)):
            if len(at):
                yield tree, at, lives
        return
    point, radius, inside, outside = tree
    d, v = (distance(np.uint64(point), prints[at]) for at in (home, visiting))
    belt = home[(d >= radius) & (d < radius + RADIUS)]
    yield from route(inside, prints, home[d < radius], np.concatenate([visiting[v < radius + RADIUS], belt]))
    yield from route(outside, prints, home[d >= radius], visiting[v >= radius - RADIUS])


def dealt(points: DataFrame, tree) -> DataFrame:
    """``shard, home, rep, print``: every fingerprint at its home and wherever it visits."""

    def run(batches):
        for batch in batches:
            reps, prints = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            everyone = np.arange(len(prints))
            for shard, at, lives in route(tree, prints.view(np.uint64), everyone, everyone[:0]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), shard, np.int32)), pa.array(np.full(len(at), lives)),
                     pa.array(reps[at]), pa.array(prints[at])],
                    names=["shard", "home", "rep", "print"],
                )

    return points.select("rep", "print").mapInArrow(run, "shard int, home boolean, rep long, print long")


class Forest:
    """Components of links that come in blocks; only a spanning forest is held."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        self.pending.append((a, b))
        self.held += len(a)
        if self.held > 1 << 19:
            self.merge()

    def merge(self) -> np.ndarray:
        if self.pending:
            a, b = (np.concatenate(x) for x in zip(*self.pending, strict=True))
            while True:
                ra, rb = self.root[a], self.root[b]
                apart = ra != rb
                if not apart.any():
                    break
                a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
                np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
                while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                    self.root = up
            self.pending, self.held = [], 0
        return self.root


def compare(prints: np.ndarray, a: np.ndarray, b: np.ndarray, forest: Forest) -> None:
    """Link every pair of ``a`` and ``b`` (positions) within the radius, block by block."""
    for i in range(0, len(a), BLOCK):
        for j in range(0, len(b), 4 * BLOCK):
            x, y = a[i : i + BLOCK], b[j : j + 4 * BLOCK]
            near = np.bitwise_count(prints[x][:, None] ^ prints[y][None, :]) <= RADIUS
            if near.any():
                k, m = near.nonzero()
                forest.link(x[k], y[m])


def cross_search(prints: np.ndarray, home: np.ndarray, others: np.ndarray, forest: Forest) -> None:
    """Links between ``home`` and ``others``."""
    if not len(others) or not len(home):
        return
    cut = split(prints[home][:: max(1, len(home) // 256)]) if len(home) > BLOCK else None
    if cut is None:
        return compare(prints, home, others, forest)
    d, v = (distance(cut[0], prints[at]) for at in (home, others))
    cross_search(prints, home[d < cut[1]], others[v < cut[1] + RADIUS], forest)
    cross_search(prints, home[d >= cut[1]], others[v >= cut[1] - RADIUS], forest)


def self_search(prints: np.ndarray, home: np.ndarray, forest: Forest) -> None:
    """Links among ``home``."""
    cut = split(prints[home][:: max(1, len(home) // 256)]) if len(home) > BLOCK else None
    if cut is None:
        return compare(prints, home, home, forest)
    d = distance(cut[0], prints[home])
    inside, outside = home[d < cut[1]], home[d >= cut[1]]
    self_search(prints, inside, forest)
    self_search(prints, outside, forest)
    cross_search(prints, inside, home[(d >= cut[1]) & (d < cut[1] + RADIUS)], forest)


def shard_links(rows: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links that a shard's own fingerprints have in it."""
    rows = rows.sort_values(["rep", "print"], ignore_index=True)
    prints, reps = rows["print"].to_numpy(), rows["rep"].to_numpy()
    lives = rows["home"].to_numpy(bool)
    forest = Forest(len(rows))
    unsigned = prints.view(np.uint64)
    self_search(unsigned, np.flatnonzero(lives), forest)
    cross_search(unsigned, np.flatnonzero(lives), np.flatnonzero(~lives), forest)
    root = forest.merge()
    at = np.flatnonzero(root != np.arange(len(rows)))
    return pd.DataFrame(
        {"rep_a": reps[at], "print_a": prints[at], "rep_b": reps[root[at]], "print_b": prints[root[at]]}
    )


def vantage_tree(points: DataFrame, n: int, shards: int):
    """Tree of vantage points, laid out on a bounded sample of the ``n`` fingerprints."""
    share = min(1.0, min(SAMPLE * shards + 1024, MAX_SAMPLE) / n)
    drawn = points.where(F.pmod(F.xxhash64("print", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = np.array(sorted(r.print for r in drawn.select("print").collect()), np.int64).view(np.uint64)
    return lay_out(np.random.default_rng(7).permutation(sample), shards)[0]


def link_prints(points: DataFrame) -> DataFrame:
    """``print, component_id, root`` of every different fingerprint (``print``, its least id ``rep``).

    ``root`` is one fingerprint of the component.
    """
    n = points.count()
    shards = -(-n // SHARD)
    tree = vantage_tree(points, n, shards) if shards > 1 else 0
    rows = spread_out(dealt(points, tree), ["shard"])
    found = rows.groupBy("shard").applyInPandas(
        shard_links, "rep_a long, print_a long, rep_b long, print_b long"
    )
    # a node is ordered by its least id, so the root of a component carries the component's least id
    edges = found.select(
        F.struct(F.col("rep_a").alias("rep"), F.col("print_a").alias("print")).alias("a"),
        F.struct(F.col("rep_b").alias("rep"), F.col("print_b").alias("print")).alias("b"),
    )
    roots = star_components(edges).select(
        F.col("node.print").alias("print"), F.col("root.rep").alias("root_rep"), F.col("root.print").alias("root_print")
    )
    least = F.coalesce("root_rep", "rep")
    return points.join(roots, "print", "left").select(
        "print", F.when(least != NO_ID, least).alias("component_id"), F.coalesce("root_print", "print").alias("root")
    )


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables: the fingerprint of every row, and the component of every fingerprint."""
    prints = stage(fingerprints(docs), "prints")
    points = stage(
        prints.groupBy("print").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("rep")), "points"
    )
    return prints, stage(link_prints(points), "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs`` (``doc_id, text``).

    ``component_id`` is the least doc_id that links of at most ``RADIUS`` bits reach, NULL if all ids of
    the component are NULL. NULL, empty and wordless texts have the fingerprint zero. Repeated rows keep one output row
    each; an empty table gives an empty result; other columns are ignored.

    Copies are grouped by fingerprint before any comparison. The last join has a hot key where one text
    makes up much of the table; adaptive execution splits it, as nothing above needs its order.
    """
    prints, components = linked(docs)
    return prints.join(components, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component of :func:`near_duplicates`, the one with the least id, with all its columns.

    A row without an id stays only if no row of its component has one.
    """
    prints, components = linked(docs)
    by_id = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("text_key"))
    chosen = prints.join(components, "print").groupBy("root").agg(F.min(by_id).alias("row"))
    rows = docs.select(
        F.struct("*").alias("doc"), F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("text_key")
    )
    # repeated rows have the same id and text
    kept = rows.join(chosen.select("row.id", "row.text_key"), ["id", "text_key"]).dropDuplicates(["id", "text_key"])
    return kept.select("doc.*")
