"""Cost-balanced packing of tokenized documents into sequences of bounded length.

Documents are dealt by a hash to groups of bounded size. A group opens just as many sequences as its tokens fill.
Pieces go, largest cost first, to the sequence with the least estimated cost among those
with room; a piece that fits nowhere whole is cut. So a group pads its last sequence only.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgrid.llm.common import map_rows
from hearthgrid.llm.word_ids import loaded
from hearthgrid.session import spread_out

LENGTH = 4096
END_ID = 2
#: Characters that a group is laid out for; a group's ids are a few MB.
GROUP_CHARS = 4_000_000
#: Attention over a piece of n tokens costs ``n + QUADRATIC * n * n``: pairs against the work per token at width 4096.
QUADRATIC = 1 / (6 * 4096)

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("spread", pa.int64())]
)
RESULT = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def tokenized(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``length`` tokens of every document, its ids ended by ``end_id``.

    ``spread`` is a hash of id and content. From the second equal piece of a task on it also takes the task and the number of the
    repeat, so that equal rows are dealt to as many groups as others.
    """
    met: Counter[int] = Counter()  # of one task, as each gets a function of its own

    def rows(ids, texts):
        words, task = loaded(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], words.dtype).tobytes()
        width = words.dtype.itemsize
        for doc_id, text in zip(ids, texts, strict=True):
            tokens = words.encode(text or "") + end
            for at in range(0, len(tokens), length * width):
                part = tokens[at : at + length * width]
                spread = xxhash.xxh64_intdigest(part, (doc_id or 0) & (1 << 64) - 1)
                met[spread] += 1
                if met[spread] > 1:
                    spread = xxhash.xxh64_intdigest(f"{task} {met[spread]}", spread)
                yield doc_id, at // width, len(tokens) // width, part, spread >> 1

    return map_rows(docs.select("doc_id", "text"), rows, PIECES)


def pack(lengths: np.ndarray, length: int = LENGTH, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """``(piece, start in the piece, length, sequence, offset)`` for pieces given by descending length.

    All sequences but the last are filled to ``length``; the last takes the rest.
    """
    total = int(lengths.sum())
    count = -(-total // length)
    room = np.full(count, length)
    room[-1:] = total - length * (count - 1)
    used, cost = np.zeros(count, np.int64), np.zeros(count)
    placed = []
    for piece, left in enumerate(lengths.tolist()):
        start = 0
        while left:
            fits = room >= left
            # whole where that is possible, else cut to the room of the least costly open sequence
            at = int(np.where(fits if fits.any() else room > 0, cost, np.inf).argmin())
            take = min(left, int(room[at]))
            placed.append((piece, start, take, at, int(used[at])))
            room[at] -= take
            used[at] += take
            cost[at] += take + quadratic * take * take
            start, left = start + take, left - take
    return placed


def pack_documents(
    docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, group_chars: int = GROUP_CHARS
) -> DataFrame:
    """Pieces of every row of ``docs`` (``doc_id, text``): ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit ids. A NULL or empty text is a document of the end id alone. Repeated
    rows are packed as often as they stand; an empty table gives an empty result; other columns are ignored.
    Pieces are dealt by a hash of id and content, so no source, length or id makes a large group.
    """
    chars = docs.agg(F.sum(F.length("text")) + F.count("*")).first()[0] or 0
    groups = max(1, -(-chars // group_chars))

    def run(pieces: pa.Table) -> pa.Table:
        dtype = loaded(vocabulary).dtype
        lengths = pc.binary_length(pieces["ids"]).to_numpy() // dtype.itemsize
        ties = [pieces[c].to_numpy() for c in ("spread", "start")] + [pieces["doc_id"].fill_null(-1).to_numpy()]
        order = np.lexsort([*ties, -lengths])
        pieces, lengths = pieces.take(order), lengths[order]
        placed = pack(lengths, length)
        piece, start, taken, sequence, offset = (np.array(x, np.int64) for x in zip(*placed, strict=True))
        ids = pieces["ids"].to_pylist()
        group = pieces["group"][0].as_py()
        cut = [
            np.frombuffer(ids[p], dtype, n, s * dtype.itemsize).astype("<u4").tobytes()
            for p, s, n in zip(piece, start, taken, strict=True)
        ]
        return pa.table(
            {
                "doc_id": pieces["doc_id"].take(piece),
                "start": pieces["start"].to_numpy()[piece] + start,
                "length": taken,
                "ids": pa.array(cut, pa.binary()),
                "doc_tokens": pieces["doc_tokens"].take(piece),
                "sequence_id": (group << 32) + sequence,
                "offset": offset,
            }
        )

    pieces = tokenized(docs, vocabulary, length, end_id)
    dealt = spread_out(pieces.withColumn("group", F.pmod("spread", F.lit(groups))), ["group"])
    return dealt.groupBy("group").applyInArrow(run, RESULT)
