"""Merkle manifest against a naive tree, and against SQL."""

import hashlib
import zlib

import duckdb
import pytest
from llm_documents import make_docs, odd_rows  # noqa: F401

from hearthgrid.llm import manifest
from hearthgrid.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc, text):
    values = doc["doc_id"], doc["source"], doc["lang"], doc["n_chars"], text
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def naive(docs):
    trees = {}
    for d in docs:
        trees.setdefault(d["source"], []).append((d["doc_id"] is not None, d["doc_id"] or 0, leaf_of(d, d["text"]), d))
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    of_source = {}
    for s in sources:
        trees[s].sort(key=lambda x: x[:3])
        of_source[s] = levels([x[2] for x in trees[s]])
    top = levels([of_source[s][-1][0] for s in sources])
    for place, s in enumerate(sources):
        for at, (_, _, leaf, d) in enumerate(trees[s]):
            tampered = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0 and d["text"] is not None
            folded = leaf_of(d, d["text"].translate(LOWER)) if tampered else leaf
            proof = ""
            for tree, i in ((of_source[s], at), (top, place)):
                for nodes in tree[:-1]:
                    run, k = nodes[i // 16 * 16 : i // 16 * 16 + 16], i % 16
                    proof += "".join(run[:k] + run[k + 1 :])
                    folded = digest("".join([*run[:k], folded, *run[k + 1 :]]))
                    i //= 16
            root = top[-1][0]
            yield d["doc_id"], leaf, of_source[s][-1][0], root, digest(proof), folded, folded == root


def check(df):
    got = sorted(map(repr, map(tuple, manifest.manifest_of(df).collect())))
    assert got == sorted(map(repr, naive([r.asDict() for r in df.collect()])))
    return got


def test_manifest_equals_naive_tree(spark, make_docs, odd_rows):
    real = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    # a source of three levels, one of a run and one more, and many sources of a lone leaf
    made = [(1000 + i, f"Text {i}", None, "large") for i in range(300)] + [(2000 + i, "x", "en", "run") for i in range(17)]
    lone = [(3000 + i, "Alone", "en", f"source-{i}") for i in range(20)]
    check(make_docs(real + odd_rows + made + lone))


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17])
def test_single_source(make_docs, n):
    docs = make_docs([(i, f"Text {i}", "en", None) for i in range(n)] or [(0, "", "en", None)])
    check(docs if n else docs.limit(0))


def test_equal_rows_are_leaves_of_their_own(make_docs):
    got = check(make_docs([(5, "Same", "en", "a")] * 40 + [(6, "Other", "en", "b")]))
    assert len(got) == 41


def test_requests_for_some_leaves(spark, make_docs):
    docs = make_docs([(i, f"Text {i}", "en", "ab"[i % 2]) for i in range(90)])
    leaves = docs.select("doc_id", manifest.tree_key().alias("tree"), manifest.leaf_digest().alias("leaf"))
    leaves = manifest.stage(manifest.ranked(manifest.stage(leaves), "tree", "doc_id", "leaf"))
    built = manifest.build(leaves)
    asked = leaves.where("doc_id in (3, 41, 42)").selectExpr("*", "leaf AS tried")
    want = {r[0]: r[4] for r in naive([r.asDict() for r in docs.collect()])}
    assert {r.doc_id: r.proof_sha256 for r in manifest.prove(built, asked).collect()} == {i: want[i] for i in (3, 41, 42)}
    assert built.records[1].count() == 6 and built.records[-1].count() == 1


def test_manifest_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        want = db.sql(ORACLES["op12_manifest"]).fetchall()
    assert sorted(map(tuple, QUERIES["op12_manifest"](spark, sf).collect())) == sorted(want)
