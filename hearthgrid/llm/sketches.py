"""Document fingerprints: threshold-scaled sketches of word shingles. DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range, whatever the document's length. Sketches of any two
documents are samples of the same hashes, so the share of one sketch found in the other estimates how much of the first document
the second one contains, also where one is a thousand times longer; and the union of sketches is the sketch of the union.
A document without a hash below the fraction keeps its least hash, so that short documents differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthgrid.llm.common import LOWER, UPPER
from hearthgrid.llm.ranks import ranked
from hearthgrid.session import stage

SHINGLE = 5
#: Hashes are kept below 2^64 / 2^BITS.
BITS = 3
FIRST_ID = "-9223372036854775809"  # stands for a NULL id, before all longs
SPACES = " \t\n\x0b\f\r"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def word_hashes(text: Column) -> Column:
    """xxHash64 of every word; A-Z are lower-cased."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER + SPACES, LOWER + " " * len(SPACES))
    words = F.filter(F.split(lowered, " ", -1), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(text: Column) -> Column:
    """xxHash64 of every run of ``SHINGLE`` word hashes, in order; of the whole sequence if it is shorter."""

    def runs(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(words) - SHINGLE)
        full = F.transform(starts, lambda i: F.xxhash64(*(words[i + k] for k in range(SHINGLE))))
        short = F.array(F.xxhash64(F.concat_ws(" ", F.transform(words, lambda w: w.cast("string")))))
        none = F.array().cast("array<long>")
        return F.when(F.size(words) >= SHINGLE, full).when(F.size(words) > 0, short).otherwise(none)

    return let(word_hashes(text), runs)


def below(value: Column) -> Column:
    """Whether a hash, read as unsigned, lies below the fraction."""
    return F.shiftrightunsigned(value, 64 - BITS) == 0


def thinned(hashes: Column) -> Column:
    """Sketch of some hashes: those below the fraction, else the least one; sorted, each once."""

    def keep(values: Column) -> Column:
        kept = F.filter(values, below)
        # in unsigned order the non-negative hashes come first
        positive = F.array_min(F.filter(values, lambda v: v >= 0))
        least = F.array_compact(F.array(F.coalesce(positive, F.array_min(values))))
        return F.sort_array(F.array_distinct(F.when(F.size(kept) > 0, kept).otherwise(least)))

    return let(hashes, keep)


def sketch(text: Column) -> Column:
    """Sketch of a text, an array of longs; empty for NULL and for a text without a word."""
    return thinned(shingle_hashes(text))


def merged(one: Column, other: Column) -> Column:
    """Sketch of two documents together, from their sketches."""
    return thinned(F.concat(one, other))


def containment(one: Column, other: Column) -> Column:
    """Estimated share of the first document's shingles that the second one has; of two empty sketches 1, of one 0."""
    share = F.size(F.array_intersect(one, other)) / F.size(one)
    return F.when(F.size(one) > 0, share).otherwise((F.size(other) == 0).cast("double"))


def dataset_sketch(docs: DataFrame, by: str) -> DataFrame:
    """``by, hash`` of the merged sketches of all documents with one value of ``by``, one row per hash.

    A row per hash lets sketches of any size be merged and compared by joins. Least hashes of short documents are left out.
    """
    hashes = docs.select(by, F.explode(sketch(F.col("text"))).alias("hash"))
    return hashes.where(below(F.col("hash"))).distinct()


def digits(hashes: Column) -> Column:
    """A sketch as text: 16 hex digits of each hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def no_id() -> Column:
    return F.lit(FIRST_ID).cast("decimal(20,0)")


def keyed(docs: DataFrame) -> DataFrame:
    """``id, key, text``, never NULL: the id, a hash of id and text, and the text. Two documents differ in id or key."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("decimal(20,0)"), no_id()).alias("id"),
        F.xxhash64(F.col("doc_id").isNull(), "text").alias("key"), F.coalesce("text", F.lit("")).alias("text"),
    )


def successors(docs: DataFrame) -> DataFrame:
    """``own_id, own_key, id, key, half``: the next document (``id, key``) of every different document, the first one after the last.

    Documents follow each other by id; of equal ids, the lesser key comes first.
    """
    known = stage(keyed(docs).select("id", "key", F.char_length("text").alias("n_chars")).distinct(), "ids")
    placed = stage(ranked(known.withColumn("all", F.lit(0)), "all", "id", "key", name="ids-ranked"), "ids-placed")
    half = F.floor(F.col("n_chars") / 2).cast("int").alias("half")
    own = placed.select(F.col("id").alias("own_id"), F.col("key").alias("own_key"), "rank", half)
    return own.join(placed.select(F.pmod(F.col("rank") - 1, "total").alias("rank"), "id", "key"), "rank").drop("rank")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Sketches of every row of ``docs`` (``doc_id, text``) and of its edited text: its last half is replaced by the start of the next document.

    ``doc_id, n_chars, edited, sketch, edited_sketch, near_edited, near_next``. The half is rounded down, in code points; of a
    shorter next document all is taken. Nearness is the containment of the row's sketch in the other one.

    NULL texts are empty; a NULL id comes first. Repeated rows are one document and keep a row each; of different texts with one
    id, the order of their hashes decides. A lone document is its own next one. An empty table gives an empty result; other
    columns are ignored.
    """
    pairs = stage(successors(docs), "next")
    # both joins take the same columns of all rows by the same keys, so the texts are shuffled once
    rows = keyed(docs)
    following = pairs.join(rows, ["id", "key"]).select(
        F.col("own_id").alias("id"), F.col("own_key").alias("key"), "half", F.expr("substring(text, 1, half)").alias("start"),
        sketch(F.col("text")).alias("next_sketch"),
    )
    # repeats of the next document give one row
    following = following.dropDuplicates(["id", "key"])
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - half)"), F.col("start"))
    both = rows.join(following, ["id", "key"]).select(
        F.when(F.col("id") > no_id(), F.col("id").cast("long")).alias("doc_id"), F.char_length("text").cast("long").alias("n_chars"),
        edited.alias("edited"), sketch(F.col("text")).alias("sketch"), sketch(edited).alias("edited_sketch"), "next_sketch",
    )
    return both.select(
        "doc_id", "n_chars", "edited", "sketch", "edited_sketch",
        containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
