"""Merkle manifest of a dataset: a content-addressed tree over documents, and inclusion proofs from it.

Every document is a leaf. The leaves of a source, by ascending id, form a tree of runs of ``FAN`` nodes; the roots of all
sources, by source, form a tree of the same kind above them. Inner nodes are records from a digest to the digests
of its children, and nothing else is needed to prove a leaf: a request descends from the root by the digits of its rank, the
children that it does not select are collected on the way, and the segments are read in reverse.

Requests with the same leading digits travel as one row until they part, so no record is looked up twice for them and the root's
record is not a hot key. A path is carried once for each run of leaves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthgrid.llm.common import LOWER, UPPER, crc_of_id
from hearthgrid.llm.ranks import ranked
from hearthgrid.session import stage

FAN, DIGIT = 16, 4  # children of a node; bits of a digit of a rank
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The key of the tree above the sources; those of sources are empty (NULL) or start with "=".
ABOVE = "above"


def field(value: Column) -> Column:
    """UTF-8 byte count, colon and value; a dash for NULL."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """Digest of a document's fields, with some of them exchanged."""
    return F.sha2(F.concat(*(field(changed.get(c, F.col(c))) for c in FIELDS)), 256)


def digest_of(children: Column) -> Column:
    return F.sha2(F.concat_ws("", children), 256)


def tree_key() -> Column:
    """Source as a key that is never NULL and sorts as the source does, NULL first."""
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))


@dataclass
class Manifest:
    """Records (``digest, children``) by level, subroots (``tree, subroot, total, rank``) and the root (None without documents).

    Levels count from 1 above the leaves; those above the sources count down from -1. ``rank`` is the place of a source.
    """

    records: dict[int, DataFrame]
    subroots: DataFrame
    root: str | None


def height(total: int) -> int:
    """Levels above the leaves."""
    levels = 0
    while total > 1:
        total, levels = -(-total // FAN), levels + 1
    return levels


def grow(nodes: DataFrame, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """Roots (``tree, digest, total``) of trees over ``nodes`` (``tree, rank, total, digest``), and the records of each level."""
    most = nodes.agg(F.max("total")).first()[0] or 0
    level = nodes.select("tree", "rank", "digest", "total", F.col("total").alias("left"))
    done, records = level.where("left = 1"), []
    for i in range(height(most)):
        runs = level.where("left > 1").groupBy("tree", F.shiftright("rank", DIGIT).alias("rank")).agg(
            F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("run"),
            F.first("total").alias("total"), F.first("left").alias("left"),
        )
        run, left = F.col("run.digest"), F.ceil(F.col("left") / FAN).alias("left")
        level = stage(
            runs.select("tree", "rank", "total", left, digest_of(run).alias("digest"), run.alias("children")), f"{name}-{i + 1}"
        )
        # equal subtrees have one record
        records.append(level.select("digest", "children").dropDuplicates(["digest"]))
        done = done.unionByName(level.where("left = 1").select(done.columns))
    return done.select("tree", "digest", "total"), records


def build(leaves: DataFrame) -> Manifest:
    """Manifest of ``leaves`` (``tree, rank, total, leaf``)."""
    subroots, records = grow(leaves.withColumnRenamed("leaf", "digest"), "manifest")
    sources = stage(
        subroots.select(F.lit(ABOVE).alias("above"), "tree", F.col("digest").alias("subroot"), F.col("total").alias("leaves")),
        "subroots",
    )
    placed = stage(ranked(sources, "above", "tree", name="sources"), "sources-ranked")
    tops = placed.select(F.col("above").alias("tree"), "rank", "total", F.col("subroot").alias("digest"))
    roots, above = grow(tops, "above")
    root = roots.first()
    by_level = dict(enumerate(records, 1)) | {-i: r for i, r in enumerate(above, 1)}
    return Manifest(by_level, placed.select("tree", "subroot", F.col("leaves").alias("total"), "rank"), root and root.digest)


def descend(records: list[DataFrame], start: DataFrame, wanted: DataFrame) -> DataFrame:
    """Go down trees from ``start`` (``tree, digest, total, path``) to the runs of leaves that hold ``wanted`` (``tree, rank``).

    ``tree, run, children, path``: ``run`` is the rank without its last digit, ``path`` holds the siblings of the levels
    passed, the lowest level first. A tree that is a lone leaf has a run without children.
    """
    levels = sum(((F.col("total") > FAN**i).cast("int") for i in range(len(records))), F.lit(0))
    start = start.select("tree", "digest", "path", F.lit(0).cast("long").alias("rank"), levels.alias("level"))
    none = F.lit(None).cast("array<string>").alias("children")
    lone = start.where("level = 0").select("tree", F.col("rank").alias("run"), none, "path")
    below = None
    for level in range(len(records), 0, -1):
        # lower trees join the walk at their own level
        here = start.where(F.col("level") == level).drop("level")
        here = (here if below is None else here.unionByName(below)).join(records[level - 1], "digest")
        if level == 1:
            return here.select("tree", F.col("rank").alias("run"), "children", "path").unionByName(lone)
        asked = wanted.select("tree", F.shiftright("rank", DIGIT * (level - 1)).alias("rank")).distinct()
        parts = here.select("tree", "path", "children", F.col("rank").alias("_up"), F.posexplode("children").alias("_digit", "digest"))
        siblings = F.concat_ws("", others(F.col("children"), F.col("_digit")))
        below = parts.select(
            "tree", "digest", F.concat(siblings, "path").alias("path"), (F.col("_up") * FAN + F.col("_digit")).alias("rank")
        ).join(asked, ["tree", "rank"], "left_semi").select("tree", "digest", "path", "rank")
    return lone


def others(children: Column, digit: Column) -> Column:
    """The children that a digit does not select."""
    return F.filter(children, lambda _, i: i != digit)


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """Requests (``tree, rank, total, leaf, tried, ...``) with ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``.

    ``tried`` is the digest to verify in the leaf's place. The proof is the digest of all siblings from the leaf's level up to the
    root, left to right; folding puts ``tried`` among the siblings of each level in turn.
    """
    spark = requests.sparkSession
    sizes = manifest.subroots.agg(F.max("total"), F.count("*")).first()
    most, sources = sizes[0] or 0, sizes[1]
    top = spark.createDataFrame(
        [(ABOVE, manifest.root, sources, "")] if manifest.root else [], "tree string, digest string, total long, path string"
    )
    upper = [manifest.records[-i] for i in range(1, height(sources) + 1)]
    lower = [manifest.records[i] for i in range(1, height(most) + 1)]
    asked = stage(requests.select("tree").distinct().join(manifest.subroots, "tree"), "asked")
    above = descend(upper, top, asked.select(F.lit(ABOVE).alias("tree"), "rank")).drop("tree")
    entered = asked.withColumn("run", F.shiftright("rank", DIGIT)).join(above, "run")
    entered = stage(entered.select("tree", "subroot", "total", "rank", F.concat(siblings_of("rank"), "path").alias("path")), "entered")
    runs = descend(lower, entered.select("tree", F.col("subroot").alias("digest"), "total", "path"), requests.select("tree", "rank"))
    own = [c for c in requests.columns if c not in ("tree", "total")]
    grouped = requests.groupBy("tree", F.shiftright("rank", DIGIT).alias("run")).agg(F.collect_list(F.struct(*own)).alias("_leaves"))
    met = grouped.join(runs, ["tree", "run"]).join(
        entered.select("tree", "subroot", F.col("total").alias("_total"), F.col("rank").alias("_source")), "tree"
    )
    others_of_tree = ["subroot", "children", "path", "_total", "_source"]
    leaves = met.select(*others_of_tree, F.explode("_leaves").alias("_leaf")).select(*others_of_tree, "_leaf.*")
    proof = F.concat(siblings_of("rank"), "path")
    return leaves.select(
        *own, "subroot", F.lit(manifest.root).alias("root"), F.sha2(proof, 256).alias("proof_sha256"),
        fold(F.col("tried"), proof, walk_of(most, sources)).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def siblings_of(rank: str) -> Column:
    """The other ``children`` of a run of leaves, concatenated; empty without children."""
    return F.concat_ws("", others(F.col("children"), (F.col(rank) % FAN).cast("int")))


def walk_of(most: int, sources: int) -> Column:
    """Array of (digit, number of siblings) for each level from a leaf to the root, from ``rank, _total`` and ``_source``."""

    def steps(rank: str, total: Column, levels: int) -> list[Column]:
        out = []
        for level in range(levels):
            left = F.floor((total + (FAN**level - 1)) / FAN**level).cast("long")
            at = F.shiftright(rank, DIGIT * level)
            run = F.least(F.lit(FAN), left - F.shiftright(at, DIGIT) * FAN)
            step = F.struct((at % FAN).cast("int").alias("digit"), (run - 1).cast("int").alias("others"))
            # a tree of less height has no such level
            out.append(F.when(left > 1, step))
        return out

    every = [*steps("rank", F.col("_total"), height(most)), *steps("_source", F.lit(sources), height(sources))]
    return F.array(*every).cast("array<struct<digit:int,others:int>>")


def fold(digest: Column, proof: Column, walk: Column) -> Column:
    """Root that follows from a leaf's digest, the concatenated siblings of all levels and the walk's digits."""

    def step(state: Column, level: Column) -> Column:
        before, every = level["digit"] * 64, level["others"] * 64
        rest = state["rest"]
        run = F.concat(rest.substr(F.lit(1), before), state["digest"], rest.substr(before + 1, every - before))
        return F.struct(rest.substr(every + 1, F.length(rest)).alias("rest"), F.sha2(run, 256).alias("digest"))

    # the proof is part of the state, so that it is put together once
    start = F.struct(proof.alias("rest"), digest.alias("digest"))
    return F.aggregate(F.filter(walk, lambda s: s.isNotNull()), start, step, lambda s: s["digest"])


def manifest_of(docs: DataFrame) -> DataFrame:
    """Proof of every row of ``docs`` (the columns ``FIELDS``): ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    Where 5 divides the crc32 of the id, the leaf that is verified comes from the text with A-Z lower-cased. NULL
    ids come first in their source and are never tampered with. Rows of equal id are ordered by their leaf, and equal rows are
    leaves of their own. A lone document is its source's root, and a lone source's root is the root. NULL and empty texts differ.
    Empty tables give an empty result; other columns are ignored.
    """
    lowered = leaf_digest(text=F.translate("text", UPPER, LOWER))
    tampered = F.coalesce(crc_of_id() % 5 == 0, F.lit(False))
    leaves = docs.select(
        "doc_id", tree_key().alias("tree"), leaf_digest().alias("leaf"), F.when(tampered, lowered).alias("changed")
    )
    # a NULL id sorts before all others
    leaves = ranked(stage(leaves, "leaves"), "tree", "doc_id", "leaf", name="leaves-ranked")
    leaves = stage(leaves, "placed")
    proven = prove(build(leaves), leaves.withColumn("tried", F.coalesce("changed", "leaf")).drop("changed"))
    return proven.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
