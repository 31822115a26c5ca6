"""Collocations of two to four words, counted by multikey quicksort of suffix pointers.

Every word position starts a suffix of at most ``DEPTH`` words. Suffixes are routed to shards by their leading words, and a shard
sorts pointers to its suffixes by three-way partitions, one word deeper in the equal part: the size of an equal partition is the
count of the phrase, and a partition below the least count is abandoned. Shards that are too large are routed again by one more
leading word; what they count of shorter phrases is a part, and parts are added up.

Words travel as 64-bit hashes of language and word; that no two words share one is checked on the table of all words, which
also turns hashes back into words. A suffix ends before a word that is too rare for any phrase.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthgrid.llm.common import LOWER, UPPER, map_rows
from hearthgrid.llm.ranks import ranked
from hearthgrid.session import stage

DEPTH = 4
LEAST = 30
TOP = 2000
#: A phrase inside a longer one goes if the longer one has at least this percentage of its occurrences.
INSIDE = 80
NO_LANG = "und"
#: Words that a task holds before it passes on their counts or suffixes.
HELD = 500_000
#: Word positions that a shard is laid out for, and suffixes above which a shard is routed again.
SHARD, LARGE = 750_000, 750_000
#: So many of the most frequent words have a number that tasks know, which is shorter than a hash.
NUMBERED = 1 << 20
#: Frequent words are marked in a bit map of this fixed size.
MAP_BITS = 24
#: Ranges of fewer pointers are sorted at once instead of being parted further.
SMALL = 512

_BREAK = b"\n"
# every separator of pieces becomes a line feed, tabs become spaces
_PIECES = bytes.maketrans((UPPER + ".,;:!?\x0b\x0c\r\t").encode(), (LOWER + "\n" * 9 + " ").encode())

WORDS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("hash", pa.int64()), ("n", pa.int64())])
BLOBS = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("rows", pa.int64()), ("blob", pa.binary())])
PHRASES = "h1 long, h2 long, h3 long, h4 long, a long"


class Numbers(dict):
    """Numbers of words in the order of their first appearance; a break of pieces is -1 and a gap between spaces -2."""

    def __init__(self) -> None:
        super().__init__({_BREAK: -1, b"": -2})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) - 2
        return number

    def of(self, text: str) -> np.ndarray:
        words = text.encode().translate(_PIECES).replace(b"\n", b" \n ").split(b" ")
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def words(self) -> list[bytes]:
        return [w for w, number in self.items() if number >= 0]

    def hashes(self, lang: str, seed: int) -> np.ndarray:
        return word_hashes(self.words(), lang, seed)


def word_hashes(words: list[bytes], lang: str, seed: int) -> np.ndarray:
    base = xxhash.xxh64_intdigest(lang.encode(), seed)
    return np.array([xxhash.xxh64_intdigest(w, base) for w in words], np.uint64).view(np.int64)


def held(batches: Iterator[tuple[list, list]]) -> Iterator[tuple[str, Numbers, np.ndarray]]:
    """Word numbers of texts by language, in lots of about ``HELD`` words; a break ends every text."""
    lots: dict[str, tuple[Numbers, list[np.ndarray]]] = {}
    size = 0
    end = np.array([-1], np.int32)
    for texts, langs in batches:
        for text, lang in zip(texts, langs, strict=True):
            numbers, parts = lots.setdefault(lang, (Numbers(), []))
            found = numbers.of(text)
            parts += [found[found != -2], end]
            size += len(found)
        if size > HELD:
            yield from ((lang, numbers, np.concatenate(parts)) for lang, (numbers, parts) in lots.items())
            lots, size = {}, 0
    yield from ((lang, numbers, np.concatenate(parts)) for lang, (numbers, parts) in lots.items())


def spoken(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit(NO_LANG)).alias("lang"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield tuple(c.to_pylist() for c in batch.slice(at, 256).columns)


def count_words(docs: DataFrame, seed: int) -> DataFrame:
    """``lang, word, hash, n`` of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, numbers, found in held(_slices(batches)):
            words = numbers.words()
            counts = np.bincount(found[found >= 0], minlength=len(words))
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(part)), pa.array(part, pa.binary()).cast(pa.string()),
                        pa.array(word_hashes(part, lang, seed)), pa.array(counts[at : at + 50_000]),
                    ],
                    schema=WORDS,
                )

    found = spoken(docs).mapInArrow(run, "lang string, word string, hash long, n long")
    return found.groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))


def unambiguous_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """The written table of all words and the seed with which their hashes differ."""
    seed = 0
    while True:
        words = stage(count_words(docs, seed), "words")
        if words.groupBy("hash").count().where("count > 1").isEmpty():
            return words, seed
        seed += 1


def frequent_map(words: DataFrame) -> np.ndarray:
    """Bit map of the words with ``LEAST`` occurrences, by the top bits of their hash; at most 2^MAP_BITS / 64 rows are collected."""
    place = F.shiftrightunsigned("hash", 64 - MAP_BITS)
    marks = words.where(F.col("n") >= LEAST).select(
        F.shiftright(place, 6).alias("slot"),
        F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - MAP_BITS}) & 63 as int))").alias("bit"),
    )
    rows = marks.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    out[rows["slot"].to_numpy()] = rows["bits"].to_numpy()
    return out


def common_words(words: DataFrame) -> np.ndarray:
    """Hashes of the ``NUMBERED`` most frequent words, in order; a word's number is its place."""
    frequent = words.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "hash").limit(NUMBERED)
    return np.sort(frequent.select("hash").toArrow()["hash"].to_numpy())


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes.view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
    return (bits[place >> 6] >> (place & 63)) & 1 == 1


def suffixes(found: np.ndarray) -> np.ndarray:
    """Rows of up to ``DEPTH`` words from each position that has two; -1 follows the end of a piece."""
    padded = np.concatenate([found, np.full(DEPTH, -1, np.int32)])
    out = np.stack([padded[k : k + len(found)] for k in range(DEPTH)], axis=1)
    for k in range(1, DEPTH):
        out[out[:, k - 1] < 0, k] = -1
    return out[out[:, 1] >= 0]


def combined(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows in order, with the sum of their weights."""
    joined = lambda a, b: (rows[:, a].astype(np.int64) + 1) << 32 | (rows[:, b] + 1)
    back, front = joined(2, 3), joined(0, 1)
    order = np.lexsort((back, front))
    back, front = back[order], front[order]
    first = np.flatnonzero(np.concatenate([[True], (back[1:] != back[:-1]) | (front[1:] != front[:-1])]))
    return rows[order[first]], np.add.reduceat(weights[order], first)


def mixed(hashes: np.ndarray, rows: np.ndarray, words: int) -> np.ndarray:
    """Unsigned hash of the leading ``words`` of each row."""
    out = np.zeros(len(rows), np.uint64)
    known = np.concatenate([hashes.view(np.uint64), np.zeros(1, np.uint64)])  # -1 takes the last
    for k in range(words):
        out = (out ^ known[rows[:, k]]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


#: Number of suffixes, common words and other words, and the bytes of a gap, a place and a weight.
HEAD = "<QQQBBB"


def narrow(values: np.ndarray) -> np.ndarray:
    """The same non-negative numbers in as few bytes as the largest needs."""
    most = int(values.max()) if values.size else 0
    return values.astype(next(f"<u{w}" for w in (1, 2, 4, 8) if most < 1 << 8 * w))


def pack(hashes: np.ndarray, rows: np.ndarray, weights: np.ndarray, common: np.ndarray) -> bytes:
    """Suffixes as bytes: the words they use, the place (0: none) of each word among these, word by word, and the weights.

    The words are gaps between the numbers of common words, then the hashes of others.
    """
    used, codes = np.unique(rows, return_inverse=True)
    own = hashes[used[used >= 0]]
    number = np.minimum(np.searchsorted(common, own), max(len(common) - 1, 0))
    known = common[number] == own if len(common) else np.zeros(len(own), bool)
    order = np.lexsort((number, ~known))
    place = np.empty(len(own), np.int64)
    place[order] = np.arange(1, len(own) + 1)
    codes = narrow(np.concatenate([np.zeros(len(used) - len(own), np.int64), place])[codes].reshape(rows.shape))
    gaps, weights = narrow(np.diff(number[known][np.argsort(number[known])], prepend=0)), narrow(weights)
    others = own[order[int(known.sum()) :]]
    head = struct.pack(HEAD, len(rows), len(gaps), len(others), gaps.itemsize, codes.itemsize, weights.itemsize)
    body = (gaps.tobytes(), others.astype("<i8").tobytes(), codes.T.tobytes(), weights.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(body))


def unpack(blob: bytes, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words, suffixes as places among them (-1: none) and weights."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, known, rare, gap, code, weight = struct.unpack_from(HEAD, raw)
    at, out = struct.calcsize(HEAD), []
    for kind, count in ((f"<u{gap}", known), ("<i8", rare), (f"<u{code}", n * DEPTH), (f"<u{weight}", n)):
        out.append(np.frombuffer(raw, kind, count, at))
        at += out[-1].nbytes
    gaps, others, codes, weights = out
    hashes = np.concatenate([common[np.cumsum(gaps, dtype=np.int64)], others]) if known else others
    return hashes, codes.reshape(DEPTH, n).T.astype(np.int32) - 1, weights.astype(np.int64)


def dealt(shards: np.ndarray, hashes: np.ndarray, rows: np.ndarray, weights: np.ndarray, common: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Shard, number of suffixes and packed suffixes, for each shard that has some."""
    order = np.argsort(shards, kind="stable")
    cuts = np.flatnonzero(np.diff(shards[order])) + 1
    for at in np.split(order, cuts):
        if len(at):
            yield int(shards[at[0]]), len(at), pack(hashes, rows[at], weights[at], common)


def routed(docs: DataFrame, shared: Broadcast, seed: int, shards: int) -> DataFrame:
    """Suffixes of all texts, dealt to shards by their two leading words: ``shard, part, rows, blob``.

    ``shared`` are the map of frequent words and the common words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, common = shared.value
        for lang, numbers, found in held(_slices(batches)):
            hashes = numbers.hashes(lang, seed)
            # the last entry stands for breaks
            frequent = np.concatenate([marked(bits, hashes), [False]])
            rows = suffixes(np.where(frequent[found], found, np.int32(-1)))
            if not len(rows):
                continue
            rows, weights = combined(rows, np.ones(len(rows), np.int32))
            shard = (mixed(hashes, rows, 2) % np.uint64(shards)).astype(np.int64)
            yield from _blob_batches((s, 0, n, blob) for s, n, blob in dealt(shard, hashes, rows, weights, common))

    return spoken(docs).mapInArrow(run, "shard long, part long, rows long, blob binary")


def _blob_batches(rows: Iterator[tuple], size: int = 64) -> Iterator[pa.RecordBatch]:
    lot: list[tuple] = []
    for row in rows:
        lot.append(row)
        if len(lot) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*lot), BLOBS, strict=True)], schema=BLOBS)
            lot = []
    if lot:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*lot), BLOBS, strict=True)], schema=BLOBS)


def rerouted(blobs: DataFrame, shared: Broadcast, words: int) -> DataFrame:
    """Blobs with a number of ``parts`` to split them into, by the hash of the leading ``words`` of each suffix."""

    def split(shards: list, parts: list, counts: list, blobs: list) -> Iterator[tuple]:
        for shard, old, n, blob in zip(shards, parts, counts, blobs, strict=True):
            hashes, rows, weights = unpack(blob, shared.value[1])
            # other bits than those that chose the shard
            part = ((mixed(hashes, rows, words) >> np.uint64(20)) % np.uint64(n)).astype(np.int64)
            for p, size, packed in dealt(part, hashes, rows, weights, shared.value[1]):
                yield shard, old * 1_000_003 + p + 1, size, packed  # parts of a part stay apart

    return map_rows(blobs.select("shard", "part", "parts", "blob"), split, BLOBS, rows=64)


def partitions(rows: np.ndarray, weights: np.ndarray, whole: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """``pointers, sizes, words`` of the equal partitions of two words and more, by multikey three-way quicksort.

    Phrases of at least ``whole`` words are complete here, and their partitions below ``LEAST`` are abandoned; those of shorter
    ones are parts and all kept. ``pointers`` name one suffix of each partition.
    """
    stack = [(np.arange(len(rows)), 0)]
    small: list[tuple[np.ndarray, int]] = []
    while stack:
        at, depth = stack.pop()
        if not len(at) or (max(depth + 1, 2) >= whole and weights[at].sum() < LEAST):
            continue
        if len(at) <= SMALL:
            small.append((at, depth))
            continue
        word = rows[at, depth]
        pivot = np.partition(word, len(word) // 2)[len(word) // 2]
        stack += [(at[word < pivot], depth), (at[word > pivot], depth)]
        equal = at[word == pivot]
        # a suffix that ends here is in no longer phrase
        if pivot < 0:
            continue
        size = weights[equal].sum()
        if depth + 1 >= whole and size < LEAST:
            continue
        if depth > 0:
            yield equal[:1], np.array([size]), depth + 1
        if depth + 1 < DEPTH:
            stack.append((equal, depth + 1))
    if small:
        yield from finished(rows, weights, small, whole)


def finished(rows: np.ndarray, weights: np.ndarray, small: list, whole: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Equal partitions below small ranges, whose pointers share as many words as the range is deep; one sort for all."""
    at = np.concatenate([a for a, _ in small])
    depth = np.repeat([d for _, d in small], [len(a) for a, _ in small])
    order = np.lexsort(tuple(rows[at, k] for k in reversed(range(DEPTH))))
    at, depth = at[order], depth[order]
    differs = np.zeros(len(at), bool)
    differs[0] = True
    for words in range(1, DEPTH + 1):
        k = words - 1
        differs[1:] |= rows[at[1:], k] != rows[at[:-1], k]
        first = np.flatnonzero(differs)
        sizes = np.add.reduceat(weights[at], first)
        # shorter phrases were counted where the range was cut off
        keep = (rows[at[first], k] >= 0) & (depth[first] < words)
        if words >= whole:
            keep &= sizes >= LEAST
        if words > 1 and keep.any():
            yield at[first[keep]], sizes[keep], words


def count_shard(key: tuple, table: pa.Table, common: np.ndarray) -> pa.Table:
    """Counts of the phrases of one shard."""
    parts = [unpack(b.as_py(), common) for b in table["blob"]]
    part = int(key[1].as_py())
    whole = int(table["words"][0].as_py()) if part else 2
    hashes, number = np.unique(np.concatenate([h for h, _, _ in parts]), return_inverse=True)
    weights = np.concatenate([w for _, _, w in parts])
    rows, start, at = np.empty((len(weights), DEPTH), np.int32), 0, 0
    for h, codes, _ in parts:
        own = np.concatenate([number[start : start + len(h)], [-1]]).astype(np.int32)
        rows[at : at + len(codes)] = own[codes]
        start, at = start + len(h), at + len(codes)
    del parts
    found = list(partitions(rows, weights, whole))
    at = np.concatenate([p for p, _, _ in found]) if found else np.zeros(0, np.int64)
    words = np.repeat([w for _, _, w in found], [len(p) for p, _, _ in found]) if found else np.zeros(0, np.int64)
    columns = {}
    for k in range(DEPTH):
        absent = words <= k
        columns[f"h{k + 1}"] = pa.array(np.where(absent, 0, hashes[np.where(absent, 0, rows[at, k])]), pa.int64(), mask=absent)
    columns["a"] = pa.array(np.concatenate([s for _, s, _ in found]) if found else np.zeros(0), pa.int64())
    return pa.table(columns)


def count_phrases(docs: DataFrame, words: DataFrame, seed: int) -> DataFrame:
    """``h1 .. h4, a`` of every phrase of two to four words with ``LEAST`` occurrences."""
    total = words.agg(F.sum("n")).first()[0] or 0
    shared = docs.sparkSession.sparkContext.broadcast((frequent_map(words), common_words(words)))
    blobs = stage(routed(docs, shared, seed, 1 + total // SHARD), "suffixes")
    parts: list[DataFrame] = []
    keys = ["shard", "part"]
    # too large shards are routed by three words, then by four: those suffixes differ, so any part is small
    for depth in range(2, DEPTH):
        sizes = blobs.groupBy(*keys).agg(F.ceil(F.sum("rows") / LARGE).alias("parts")).where("parts > 1")
        sizes = stage(sizes, "large-shards")
        if sizes.isEmpty():
            break
        parts.append(blobs.join(sizes, keys, "left_anti").withColumn("words", F.lit(depth)))
        blobs = stage(rerouted(blobs.join(sizes, keys), shared, depth + 1), f"suffixes-{depth + 1}")
    else:
        depth = DEPTH
    parts.append(blobs.withColumn("words", F.lit(depth)))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    counted = every.select("shard", "part", "words", "blob").groupBy("shard", "part").applyInArrow(
        lambda key, table: count_shard(key, table, shared.value[1]), PHRASES
    )
    sums = counted.groupBy("h1", "h2", "h3", "h4").agg(F.sum("a").alias("a")).where(F.col("a") >= LEAST)
    return stage(sums, "phrases")


def exact(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def phrase_scores(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``key, a, l, r, score`` of every phrase (``key``: the hashes of its words) that no longer one makes superfluous."""
    keyed = phrases.select(F.array_compact(F.array("h1", "h2", "h3", "h4")).alias("key"), "a")
    counts = stage(
        keyed.select("key", F.col("a").alias("f")).unionByName(
            words.where(F.col("n") >= LEAST).select(F.array("hash").alias("key"), F.col("n").alias("f"))
        ),
        "counts",
    )
    size = F.size("key")
    cuts = keyed.select("key", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    sides = cuts.select(
        "key", "a", "k", F.slice("key", 1, F.col("k")).alias("left"), F.slice("key", F.col("k") + 1, size - F.col("k")).alias("right")
    )
    left, right = (counts.select(F.col("key").alias(s), F.col("f").alias(n)) for s, n in (("left", "l"), ("right", "r")))
    both = sides.join(left, "left").join(right, "right")
    score = F.expr("(cast(2000000 as decimal(8,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    weakest = both.withColumn("score", score).groupBy("key").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("cut"))
    # longest first: every phrase inside a longer one, with the longer one's count
    at = F.explode(F.sequence(F.lit(1), size - F.col("k") + 1)).alias("at")
    lengths = F.explode(F.sequence(F.lit(2), size - 1)).alias("k")
    inner = keyed.where(size > 2).select("key", "a", lengths).select("key", "a", "k", at)
    inner = inner.select(F.slice("key", F.col("at"), F.col("k")).alias("key"), F.col("a").alias("longer"))
    inner = inner.groupBy("key").agg(F.max("longer").alias("longer"))
    kept = weakest.join(inner, "key", "left").where(
        F.col("longer").isNull() | (exact(F.col("longer")) * 100 < exact(F.col("cut.a")) * INSIDE)
    )
    return kept.select("key", "cut.a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """First ``top`` phrases of every language of ``docs`` (``text, lang``): ``lang, rank, phrase, a, l, r, n, score``.

    A phrase of two to four words lies within a piece and has ``a`` occurrences, at least ``LEAST``. Its score is that of
    its weakest cut into ``l`` and ``r``, the counts of both sides; ``n`` counts all words of the language. A phrase inside a longer one
    with at least ``INSIDE`` percent of its occurrences is left out. Ties go to the more frequent, then to the lesser phrase by bytes.

    A NULL language is ``und``, a NULL text is empty. Repeated rows count each time; an empty table gives an empty result; other
    columns are ignored.
    """
    words, seed = unambiguous_words(docs)
    scored = stage(phrase_scores(count_phrases(docs, words, seed), words), "scored")
    named = scored.select("key", F.posexplode("key").alias("at", "hash")).join(
        words.where(F.col("n") >= LEAST).select("hash", "lang", "word"), "hash"
    )
    texts = named.groupBy("key").agg(
        F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words")
    )
    phrases = scored.join(texts, "key").select(
        "lang", F.concat_ws(" ", "words.word").alias("phrase"), "a", "l", "r", "score", (-F.col("score")).alias("_score"), (-F.col("a")).alias("_a")
    )
    # ranks come from a sort in ranges, so no task holds a language
    ranks = ranked(stage(phrases, "named"), "lang", "_score", "_a", "phrase", name="best").where(F.col("rank") < top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranks.join(totals, "lang").select("lang", (F.col("rank") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")
