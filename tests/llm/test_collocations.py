"""Collocations against a naive count and against SQL."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from llm_documents import make_docs, odd_rows  # noqa: F401

from hearthgrid.llm import collocations
from hearthgrid.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def naive(rows, least=30, top=2000):
    counts, sizes = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        f = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, 5):
                f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in cands.items():
            for k in range(2, len(p)):
                gone |= {p[i : i + k] for i in range(len(p) - k + 1) if 100 * a >= 80 * f[p[i : i + k]]}
        scored = []
        for p, a in cands.items():
            if p not in gone:
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def found(docs):
    return sorted(map(tuple, collocations.collocations(docs).collect()))


@pytest.fixture
def made():
    """Texts with frequent phrases, nested ones, a very frequent pair and one language only in NULL."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(700):
        words = [f"w{int(x)}" for x in rng.zipf(1.4, 25) if x < 400]
        for phrase in ("New York", "new york city", "à la carte", "of the", "of the", "one two three four five"):
            if rng.random() < 0.5:
                words.insert(int(rng.integers(0, len(words) + 1)), phrase)
        text = " ".join(w + "," * bool(rng.random() < 0.05) for w in words)
        rows.append((i, text, ["en", "de", None][i % 3], "s"))
    return rows


def test_equals_naive_count(make_docs, odd_rows, made):
    rows = made + odd_rows
    want = naive([(t, g) for _, t, g, _ in rows])
    assert found(make_docs(rows)) == want and len({r[0] for r in want}) == 3


def test_large_shards_are_routed_again(make_docs, made, monkeypatch):
    want = naive([(t, g) for _, t, g, _ in made])
    # every shard is too large for two and for three leading words, and every lot is small
    for name, value in {"SHARD": 2000, "LARGE": 100, "SMALL": 4, "HELD": 500}.items():
        monkeypatch.setattr(collocations, name, value)
    docs = make_docs(made).repartition(5)
    assert found(docs) == want


def test_no_phrase(make_docs):
    docs = make_docs([(1, "too short", "en", "a")])
    assert found(docs) == [] and found(docs.limit(0)) == []


def test_partitions_equal_counts():
    rng = np.random.default_rng(0)
    rows = collocations.suffixes(rng.integers(-1, 6, 4000).astype(np.int32))
    rows, weights = collocations.combined(rows, np.ones(len(rows), np.int64))
    for small in (1, 64, 10_000):
        collocations.SMALL, before = small, collocations.SMALL
        try:
            got = {}
            for at, sizes, words in collocations.partitions(rows, weights, 2):
                for a, size in zip(at, sizes, strict=True):
                    key = tuple(rows[a, :words].tolist())
                    assert key not in got
                    got[key] = int(size)
        finally:
            collocations.SMALL = before
        want = Counter()
        for row, weight in zip(rows.tolist(), weights.tolist(), strict=True):
            for k in range(2, 5):
                if row[k - 1] >= 0:
                    want[tuple(row[:k])] += weight
        assert got == {p: n for p, n in want.items() if n >= 30}


def test_scores_are_exact_beyond_64_bits(spark):
    """Counts whose products pass 64 bits."""
    big = 9 * 10**17
    phrases = spark.createDataFrame([(1, 2, None, None, big)], "h1 long, h2 long, h3 long, h4 long, a long")
    words = spark.createDataFrame([(1, big + 1), (2, big + 7)], "hash long, n long")
    (r,) = collocations.phrase_scores(phrases, words).collect()
    assert (r.a, r.l, r.r, r.score) == (big, big + 1, big + 7, 2_000_000 * big // (2 * big + 8))


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        want = db.sql(ORACLES["op11_collocations"]).fetchall()
    assert sorted(map(tuple, QUERIES["op11_collocations"](spark, sf).collect())) == sorted(want)
