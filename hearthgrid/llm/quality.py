"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown on a bounded sample of labelled rows, over feature histograms of 64 bins. All trees are
complete and of one depth, so the model is three flat arrays, and a batch of documents goes down all
trees at once with numpy indexing.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthgrid.llm.common import WORD, crc_of_id, edit_texts, map_rows
from hearthgrid.llm.trees import FlatTrees, Histograms

#: Bound on the labelled rows that a model is fitted on (in expectation; rows are drawn by a hash of the id).
MAX_TRAIN = 20_000
TREES, DEPTH = 60, 4
RATE, L2, MIN_HESSIAN = 0.15, 1.0, 2.0

WORDS = re.compile(WORD)
FEATURES = (
    "log_chars", "log_words", "mean_word", "max_word", "letters", "upper", "digits", "marks", "symbols",
    "spaces", "lines", "words_per_line", "dup_lines", "distinct_words", "repeated_windows", "top_word",
    "wordless", "marked_words", "ended_lines", "bullets", "short_words", "pipes", "shouts", "upper_words",
)
# classes of code points below 0x3000: letter, upper-case letter, digit, punctuation, symbol, space, other
_KIND = {"Ll": 0, "Lo": 0, "Lm": 0, "Lt": 1, "Lu": 1, "Zs": 5, "Cc": 5}
_KIND_OF = {"N": 2, "P": 3, "S": 4, "M": 0, "Z": 5}
_TABLE = np.array(
    [_KIND.get(k := unicodedata.category(chr(c)), _KIND_OF.get(k[0], 6)) for c in range(0x3000)], np.uint8
)


def statistics(text: str | None) -> list[float]:
    """The values of :data:`FEATURES`; zeros for an empty or NULL text."""
    if not text:
        return [0.0] * len(FEATURES)
    kinds = np.zeros(7, np.int64)
    for at in range(0, len(text), 1 << 20):  # bounded memory for very long texts
        codes = np.frombuffer(text[at : at + (1 << 20)].encode("utf-32-le"), np.uint32)
        kinds += np.bincount(_TABLE[np.minimum(codes, 0x2FFF)], minlength=7)
    chars = len(text)
    words = WORDS.findall(text)
    n = max(len(words), 1)
    counts = Counter(map(sys.intern, words))
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(len(lines), 1)
    windows = max(len(words) - 2, 1)
    different = len(set(zip(words, words[1:], words[2:], strict=False))) if len(words) > 2 else 1
    lengths = list(map(len, words)) or [0]
    return [
        float(np.log1p(chars)),
        float(np.log1p(len(words))),
        sum(lengths) / n,
        min(max(lengths), 1000),
        (kinds[0] + kinds[1]) / chars,
        kinds[1] / max(kinds[0] + kinds[1], 1),
        kinds[2] / chars,
        kinds[3] / chars,
        kinds[4] / chars,
        kinds[5] / chars,
        float(np.log1p(len(lines))),
        len(words) / m,
        1 - len(set(lines)) / m,
        len(counts) / n,
        1 - different / windows,
        max(counts.values(), default=0) / n,
        sum(c for w, c in counts.items() if not any(map(str.isalpha, w))) / n,
        sum(c for w, c in counts.items() if not w[-1].isalnum()) / n,
        sum(x.rstrip()[-1] in ".!?:;\"'" for x in lines) / m,
        sum(x.lstrip()[0] in "-*•·#>" for x in lines) / m,
        sum(c for w, c in counts.items() if len(w) <= 2) / n,
        (text.count("|") + text.count("\t")) / chars,
        (text.count("!") + text.count("?")) / chars,
        sum(c for w, c in counts.items() if w.isupper()) / n,
    ]


@dataclass
class Boosted:
    """Trees whose leaves add up to log odds above ``base``."""

    trees: FlatTrees
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        return 1 / (1 + np.exp(-self.base - self.trees.totals(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Boosted:
    """Boost ``trees`` complete trees on the log loss; needs rows of both labels, else only the prior is kept."""
    rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    base = float(np.log(rate / (1 - rate)))
    if len(set(y.tolist())) < 2:
        return Boosted(FlatTrees.empty(0, depth), base)
    model, cells, total = FlatTrees.empty(trees, depth), Histograms(x), np.full(len(x), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        place = cells.grow(model, t, grad, hess, L2, MIN_HESSIAN)
        g, h = (np.bincount(place, w, 2**depth) for w in (grad, hess))
        model.leaf[t] = -RATE * g / (h + L2)
        total += model.leaf[t, place]
    return Boosted(model, base)


def held_out(column: str = "doc_id", parts: int = 3, part: int = 1) -> Column:
    """True for rows that no model may learn from; an unknown id is never learned from."""
    return F.coalesce(F.pmod(crc_of_id(column), F.lit(parts)) == part, F.lit(True))


VECTOR = pa.schema([("label", pa.int32()), ("x", pa.list_(pa.float64()))])
RESULT = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())]
)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Boosted:
    """Fit on at most about ``max_train`` labelled documents outside of the held-out part.

    Rows of ``labels`` (``doc_id, quality``) with a NULL or with another value than 0 and 1 are left out. The drawn
    labels are a few hundred kB by that bound and so may be broadcast; only statistics of their
    documents come to the driver.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select(
        "doc_id", F.col("quality").cast("int").alias("label")
    )
    n = known.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit("quality sample")), F.lit(1 << 30))
    drawn = known.where(part < int(min(1.0, max_train / max(n, 1)) * (1 << 30))).dropDuplicates()
    # repeated rows of a drawn id teach nothing more
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").dropDuplicates()
    vectors = map_rows(
        texts.select("label", "text"),
        lambda ys, ts: ((y, statistics(t)) for y, t in zip(ys, ts, strict=True)),
        VECTOR,
    ).toArrow()
    y = vectors["label"].to_numpy().astype(float)
    x = np.array(vectors["x"].to_pylist(), float).reshape(len(y), len(FEATURES))
    order = np.lexsort([*x.T, y])  # the same sums in each run
    return fit_trees(x[order], y[order])


def score_documents(docs: DataFrame, model: Boosted) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs`` (``doc_id, text``).

    A NULL text is scored as an empty one. Repeated rows keep one output row each, a NULL id counts as held out, an
    empty table gives an empty result, and other columns are ignored.
    """

    def rows(ids, outs, texts):
        scores = model.score(np.array([statistics(t) for t in texts], float))
        for i, out, s in zip(ids, outs, scores.tolist(), strict=True):
            yield i, out, s, int(s >= 0.5)

    return map_rows(docs.select("doc_id", held_out().alias("held_out"), "text"), rows, RESULT)


def filter_documents(docs: DataFrame, model: Boosted) -> DataFrame:
    """The rows of ``docs`` that the model gives label 1, with all their columns."""

    def edit(texts):
        return (model.score(np.array([statistics(t) for t in texts], float)) >= 0.5).tolist(), texts

    return edit_texts(docs, edit)
