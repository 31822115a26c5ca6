"""Vector search, SimHash, components, and the pipeline."""

import re

import numpy as np
import pytest
import xxhash
from llm_documents import make_docs, odd_rows  # noqa: F401

import __spark_entry__
import corpus_pipeline
from hearthgrid.llm import simhash, vector_graph
from hearthgrid.llm.graph import star_components
from hearthgrid.llm.queries import QUERIES


def exact(ids, x, every=20, k=20):
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        s[i] = -np.inf
        order = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
        yield int(ids[i]), ids[order].tolist(), s[order]


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    # vectors of very different lengths, as the measure is the inner product
    x = (rng.normal(size=(3000, 24)) * rng.lognormal(0, 0.5, (3000, 1))).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), "s") for i, v in enumerate(x)], "vec_id long, embedding array<float>, score string")
    found = {}
    for r in vector_graph.nearest(df, shard=700, block=64).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = []
    for q, want, _ in exact(np.arange(3000), x):
        got = sorted(found[q])
        assert [g[0] for g in got] == list(range(1, 21))
        assert [(-g[2], g[1]) for g in got] == sorted((-g[2], g[1]) for g in got)
        assert np.allclose([g[2] for g in got], [x[q] @ x[g[1]] for g in got], rtol=1e-12)
        hits.append(len({g[1] for g in got} & set(want)) / 20)
    assert np.mean(hits) > 0.9


def test_neighbours_odd_vectors(spark):
    good = [(i, [1.0, float(i % 3)]) for i in range(0, 45)]
    odd = [
        (100, None), (120, []), (140, [0.0, 0.0]), (160, [1.0, None]), (180, [float("nan"), 1.0]), (200, [float("inf"), 1.0]),
        (None, [1.0, 1.0]), (0, [1.0, 0.0]), (220, [1.0, 1.0, 1.0]),
    ]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<float>")
    got = {}
    for r in vector_graph.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids, x = np.array([g[0] for g in good]), np.array([g[1] for g in good])
    # many equal vectors: ties go to the smaller id, and a lone vector of its length finds nothing
    assert set(got) == {0, 20, 40}
    for q, want, scores in exact(ids, x):
        assert [g[1] for g in sorted(got[q])] == want and np.allclose([g[2] for g in sorted(got[q])], scores)
    few = vector_graph.nearest(df.where("vec_id < 5")).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3, 4]
    assert vector_graph.nearest(df.limit(0)).count() == 0
    assert vector_graph.nearest(df.where("vec_id = 7")).count() == 0


def test_graph_is_searchable_with_few_points():
    for n in (1, 2, 3, 40):
        points = vector_graph.lifted(np.random.default_rng(n).normal(size=(n, 4)))
        links, start = vector_graph.build_graph(points, degree=4, beam=8)
        ids, _ = vector_graph.beam_search(points, links, start, points, 8)
        assert all(i in ids[i] for i in range(n))


def naive_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(items):
    """Least id by item of ``(id, value)`` linked at 3 bits or fewer."""
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(items):
        for j in range(i):
            if (a ^ items[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(items):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(items))]


def test_simhash_equals_brute_force(spark, make_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 40)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(1000 + r.doc_id, r.text, "en", "s") for r in docs] + odd_rows
    got = simhash.near_duplicates(make_docs(rows)).collect()
    items = [(r[0], naive_print(r[1])) for r in rows]
    want = [(i, f"{p:016x}", c) for (i, p), c in zip(items, naive_components(items), strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert simhash.near_duplicates(make_docs(rows).limit(0)).count() == 0


@pytest.mark.parametrize("shards", [1, 7, 30])
def test_trees_find_all_links(spark, shards, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(shards)
    centres = rng.integers(0, 1 << 63, 150, np.uint64)
    prints = {int(c) for c in centres}
    for c in centres[:60]:  # chains and dense groups around some points
        at = int(c)
        for _ in range(12):
            for b in rng.choice(64, rng.integers(1, 4), False):
                at ^= 1 << int(b)
            prints.add(at)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    monkeypatch.setattr(simhash, "SHARD", -(-len(prints) // shards))
    points = spark.createDataFrame([(p, i) for i, p in enumerate(signed)], "print long, rep long")
    got = {r.print: r.component_id for r in simhash.link_prints(points).collect()}
    assert [got[p] for p in signed] == naive_components(list(enumerate(prints)))


def test_drop_near_duplicates_keeps_one(make_docs):
    words = [f"w{i}" for i in range(300)]
    changed = [[*words[:i], "changed", *words[i + 1 :]] for i in range(0, 300, 10)]
    near = next(w for w in changed if 0 < (naive_print(" ".join(words)) ^ naive_print(" ".join(w))).bit_count() <= 3)
    rows = [
        (3, " ".join(words), "en", "a"), (2, " ".join(near), "en", "a"), (9, " ".join(words), "en", "b"),
        (2, " ".join(near), "en", "a"), (None, " ".join(words), "en", "b"), (5, "quite another text", "en", "a"),
        (None, "rows without any id", "en", "a"), (None, "rows without any id", "en", "a"), (7, None, "en", None), (8, "", None, "a"),
    ]
    docs = make_docs(rows)
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "5", "7", "None"]
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_star_components(spark):
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 160)] + rng.integers(200, 260, (50, 2)).tolist()
    got = {r.node: r.root for r in star_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert got == {i: find(i) for i in list(parent) if find(i) != i}
    assert star_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_equals_its_stages_by_hand(spark):
    """Each stage against its operator's own verdicts on the stage's input."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "quality_classifier", "near_dedup", "secrets", "packing"]

    from hearthgrid.llm import line_rules, quality
    from hearthgrid.session import stage

    ruled = stage(stages["quality_rules"](spark, docs, sf), "t")
    assert ids(ruled) == ids(line_rules.judge_documents(docs).where("kept")) and ruled.columns == docs.columns
    good = stage(stages["quality_classifier"](spark, ruled, sf), "t")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert ids(good) == ids(quality.score_documents(ruled, model).where("predicted = 1")) and good.columns == docs.columns
    single = stage(stages["near_dedup"](spark, good, sf), "t")
    items = [(r.doc_id, naive_print(r.text)) for r in good.collect()]
    assert ids(single) == sorted(set(naive_components(items)))
    masked = stage(stages["secrets"](spark, single, sf), "t")
    assert ids(masked) == ids(single) and masked.columns == docs.columns
    pieces = stages["packing"](spark, masked, sf)
    rows = lambda df: sorted((r.doc_id, r.start, r.length, bytes(r.ids)) for r in df.collect())
    assert {r[0] for r in rows(pieces)} == set(ids(masked))
    assert rows(corpus_pipeline.run(spark, sf)) == rows(pieces)


def test_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
