"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgrid.session import stage


def star_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``) that isn't the least of its component.

    Alternates the large-star and the small-star step (Kiveris et al., 2014) until nothing changes. Least neighbours are
    aggregates, combined before the shuffle, and are joined back, so a node with very many
    neighbours is never gathered in one task. Each round is written to the shared folder.
    Edges with a NULL end and loops are left out.
    """

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))

    def oriented(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where(F.col("a") != F.col("b"))
        return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(pairs: DataFrame) -> tuple:
        row = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    current = stage(oriented(edges), "edges")
    before, now = None, state(current)
    while now[0] and before != now:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: the greater neighbours of a node go to its least neighbour
        large = both.join(least(both), "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(oriented(large), "large-star")
        # small star: the smaller neighbours of a node and the node itself go to the least of them
        small = least(large)
        moved = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = small.select("a", F.col("m").alias("b"))
        current = stage(oriented(moved.unionByName(own)), "small-star")
        before, now = now, state(current)
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
