"""Language identification: the family first, then one-versus-one linear SVMs between its languages.

A text is a vector of hashed character 1- to 3-grams over lower-cased letters. Both levels are one-versus-one linear
support vector machines, fitted by dual coordinate descent on a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthgrid.llm.common import crc_of_id, map_rows
from hearthgrid.llm.quality import _TABLE as CHARACTER_KINDS

DIM = 4096
#: Bound on the rows that are fitted for each language (in expectation; drawn by a hash of the id).
MAX_PER_LANGUAGE = 500
COST, EPOCHS = 1.0, 15
#: A margin of m against another class counts as a probability of 1 / (1 + exp(-STEEP * m)).
STEEP = 3.0
UNKNOWN = "und"

# Language families by ISO 639-1 code. Any other value is a family of its own.
FAMILIES = {
    "germanic": "de en nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he mt am",
    "indic": "hi ur bn pa mr gu ne si",
    "dravidian": "ta te kn ml",
    "malayic": "id ms jv tl",
    "sinitic": "zh",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
LETTER = regex.compile(r"\p{L}")


def family(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], lang)


def features(text: str) -> np.ndarray:
    """Square roots of n-gram shares, each order of n-grams of length one."""
    counts = np.zeros((3, DIM))
    text = text.lower()
    step = 1 << 20  # bounded memory for very long texts
    for at in range(0, len(text), step):
        codes = np.frombuffer(text[at : at + step].encode("utf-32-le"), np.uint32)
        letters = (codes >= 0x3000) | (CHARACTER_KINDS[np.minimum(codes, 0x2FFF)] < 2)
        codes = np.where(letters, codes, 32)
        keep = letters.copy()
        keep[0] = True
        keep[1:] |= letters[:-1]  # one blank after each run of letters
        codes = codes[keep].astype(np.uint64)
        gram = codes
        for n in range(3):
            if n:
                gram = gram[:-1] * np.uint64(0x1FFFFF) + codes[n:]
            slots = (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
            counts[n] += np.bincount(slots.astype(np.int64), minlength=DIM)
    totals = counts.sum(axis=1, keepdims=True)
    return np.sqrt(counts / np.maximum(totals, 1)).sum(axis=0)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of a linear SVM (hinge loss) for labels -1 and 1; the last one is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    norms, alpha, w = (x * x).sum(axis=1), np.zeros(len(x)), np.zeros(x.shape[1])
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            step = np.clip(alpha[i] - (y[i] * (w @ x[i]) - 1) / norms[i], 0, cost) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
    return w


@dataclass
class Duel:
    """One-versus-one classifier: ``weights[i]`` parts the classes of ``pairs[i]``."""

    classes: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> Duel:
        classes = sorted(set(labels.tolist()))
        duel = cls(classes, list(combinations(range(len(classes)), 2)))
        rows = []
        for a, b in duel.pairs:
            at = np.flatnonzero((labels == classes[a]) | (labels == classes[b]))
            rows.append(fit_svm(x[at], np.where(labels[at] == classes[a], 1.0, -1.0)))
        duel.weights = np.array(rows)
        return duel

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Mean probability of each class against the others, by row."""
        k = len(self.classes)
        if k == 1:
            return np.ones((len(x), 1))
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        wins = 1 / (1 + np.exp(-STEEP * margins))
        out = np.zeros((len(x), k))
        for n, (a, b) in enumerate(self.pairs):
            out[:, a] += wins[:, n]
            out[:, b] += 1 - wins[:, n]
        return out / (k - 1)


@dataclass
class LanguageModel:
    families: Duel
    within: dict[str, Duel]

    @classmethod
    def fit(cls, x: np.ndarray, langs: np.ndarray) -> LanguageModel | None:
        if not len(x):
            return None
        groups = np.array([family(v) for v in langs.tolist()], object)
        return cls(Duel.fit(x, groups), {g: Duel.fit(x[groups == g], langs[groups == g]) for g in sorted(set(groups))})

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row."""
        shares = self.families.shares(x)
        chosen, score = shares.argmax(axis=1), shares.max(axis=1)
        langs = [""] * len(x)
        for f in set(chosen.tolist()):
            at = np.flatnonzero(chosen == f)
            duel = self.within[self.families.classes[f]]
            inner = duel.shares(x[at])
            score[at] *= inner.max(axis=1)
            for i, c in zip(at, inner.argmax(axis=1), strict=True):
                langs[i] = duel.classes[c]
        return langs, score


def held_out(column: str = "doc_id") -> Column:
    """True for rows that no model may learn from; an unknown id is never learned from."""
    return F.coalesce(F.pmod(crc_of_id(column), F.lit(4)) == 2, F.lit(True))


VECTOR = pa.schema([("lang", pa.string()), ("x", pa.list_(pa.float32()))])
RESULT = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())]
)


def train(docs: DataFrame, per_language: int = MAX_PER_LANGUAGE) -> LanguageModel | None:
    """Fit on about ``per_language`` documents of each non-NULL ``lang`` outside of the held-out part.

    Documents without a letter teach nothing and are left out. None if nothing is left.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    limits = [
        F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, int(min(1.0, per_language / n) * (1 << 30)))
    ]
    part = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30))
    drawn = known.where(part < F.element_at(F.create_map(*limits), F.col("lang")))
    # repeated rows of a drawn id teach nothing more
    drawn = drawn.select("doc_id", "lang", "text").dropDuplicates()
    table = map_rows(
        drawn.select("lang", "text"),
        lambda langs, texts: ((v, features(t).astype("f4")) for v, t in zip(langs, texts, strict=True)),
        VECTOR,
        rows=200,
    ).toArrow()
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(-1, DIM).astype(float)
    langs = np.array(table["lang"].to_pylist(), object)
    order = sorted(range(len(x)), key=lambda i: (langs[i], x[i].tobytes()))  # the same steps in each run
    return LanguageModel.fit(x[order], langs[order])


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs`` (``doc_id, text``).

    ``lang_pred`` is ``und`` with score 0 for a NULL text, one without a letter, or without a model. Repeated rows
    keep one output row each, a NULL id counts as held out, an empty table gives an empty result, and other
    columns are ignored.
    """

    def rows(ids, outs, texts):
        found = [bool(model and t and LETTER.search(t)) for t in texts]
        langs, scores = [], []
        if any(found):
            langs, scores = model.predict(np.array([features(t) for t, ok in zip(texts, found, strict=True) if ok]))
        known = iter(zip(langs, map(float, scores), strict=True))
        for doc_id, out, ok in zip(ids, outs, found, strict=True):
            yield doc_id, out, *(next(known) if ok else (UNKNOWN, 0.0))

    return map_rows(docs.select("doc_id", held_out().alias("held_out"), "text"), rows, RESULT)
