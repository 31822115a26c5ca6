"""Threshold-scaled sketches against a naive count."""

import re
import struct

import xxhash
from llm_documents import make_docs, odd_rows  # noqa: F401
from pyspark.sql import functions as F

from hearthgrid.llm import sketches

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    if 0 < len(words) < 5:
        return {xxhash.xxh64_intdigest(" ".join(str(signed(h)) for h in hashes).encode(), 42)}
    out = set()
    for i in range(len(words) - 4):
        h = 42
        for w in hashes[i : i + 5]:
            h = xxhash.xxh64_intdigest(struct.pack("<Q", w), h)
        out.add(h)
    return out


def naive(text):
    every = shingles(text)
    kept = {h for h in every if h < 1 << 61}
    return sorted(map(signed, kept or sorted(every)[:1]))


def share(a, b):
    return len(set(a) & set(b)) / len(a) if a else float(not b)


def test_compare_equals_naive(spark, make_docs, odd_rows):
    real = [(1000 + r.doc_id, r.text, "en", "s") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = real + odd_rows
    distinct = {(i is not None, i or 0, t): None for i, t, _, _ in rows}
    order = sorted(distinct, key=lambda d: d[:2])
    got = {}
    for r in sketches.compare_with_next(make_docs(rows)).collect():
        got.setdefault((r.doc_id, r.edited), []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    # documents of one id follow each other in the order of a hash: leave those out
    alone = [i for i, d in enumerate(order) if sum(d[:2] == e[:2] for e in (order[i - 1], *order[i : i + 2], order[0])) == 1]
    alone = [i for i in alone if order[(i + 1) % len(order)][0]]
    assert len(alone) > 200
    for i in alone:
        text, follower = order[i][2] or "", order[(i + 1) % len(order)][2] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + follower[:half]
        (r, *_) = got[order[i][1], edited]
        a, b, c = naive(text), naive(edited), naive(follower)
        assert (r.n_chars, r.sketch, r.edited_sketch) == (len(text), a, b)
        assert (r.near_edited, r.near_next) == (share(a, b), share(a, c))
    repeats = got[4, "same" + sketches_next(order, 4)[:4]]
    assert len(repeats) == 2 and repeats[0] == repeats[1]


def sketches_next(order, doc):
    at = next(i for i, d in enumerate(order) if d[1] == doc and d[0])
    return order[at + 1][2] or ""


def test_lone_and_no_document(make_docs):
    docs = make_docs([(7, "One Two three four five six", "en", "a")])
    (r,) = sketches.compare_with_next(docs).collect()
    assert r.edited == "One Two three " + "One Two three" and r.near_next == 1.0
    assert sketches.compare_with_next(docs.limit(0)).count() == 0


def test_fraction_and_containment_of_unequal_documents(spark):
    words = [f"w{i}" for i in range(30_000)]
    part = words[10_000:12_000]
    df = spark.createDataFrame([(" ".join(words), " ".join(part))], "long string, short string")
    whole, some = sketches.sketch(F.col("long")), sketches.sketch(F.col("short"))
    r = df.select(
        F.size(whole).alias("n"), sketches.containment(some, whole).alias("inside"), sketches.containment(whole, some).alias("back"),
        sketches.merged(some, whole).alias("merged"), whole.alias("whole"),
    ).first()
    assert abs(r.n / 30_000 - 1 / 8) < 0.01
    assert r.inside == 1.0 and abs(r.back - 2_000 / 30_000) < 0.02
    assert r.merged == r.whole


def test_merging_and_datasets(spark, make_docs):
    texts = [f"word{i} and word{i + 1} then word{i + 2} or word{i + 3}" for i in range(0, 40)]
    docs = make_docs([(i, t, "en", "ab"[i % 2]) for i, t in enumerate(texts)])
    both = docs.select(sketches.sketch(F.col("text")).alias("s")).agg(F.flatten(F.collect_list("s")).alias("s"))
    merged = both.select(sketches.thinned(F.col("s")).alias("s")).first().s
    every = set().union(*map(shingles, texts))
    assert merged == sorted(signed(h) for h in every if h < 1 << 61)
    rows = {(r.source, r["hash"]) for r in sketches.dataset_sketch(docs, "source").collect()}
    assert rows == {("ab"[i % 2], h) for i, t in enumerate(texts) for h in shingles(t) if h < 1 << 61}


def test_short_texts_differ(spark):
    df = spark.createDataFrame([(t,) for t in ["a", "b", "", "  ", "a b", "A b", "ab"]], "text string")
    got = [r.f for r in df.select(sketches.digits(sketches.sketch(F.col("text"))).alias("f")).collect()]
    assert got[2] == got[3] == "" and got[4] == got[5] and len(set(got)) == 5
