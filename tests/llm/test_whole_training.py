"""Words and forest of the secret scan come from every document, and do not depend on how rows are dealt."""

import numpy as np
import pytest
from llm_documents import make_docs, odd_rows  # noqa: F401

import corpus_pipeline
from hearthgrid.llm import forests, secret_scan
from hearthgrid.session import stage


@pytest.fixture(scope="module")
def large(spark):
    """22,000 documents, 11 of them with a rare word, a number each, and 30 copies of one text."""
    return spark.sql(
        "SELECT id AS doc_id, concat('paid ', 7000000000000 + 97 * id, ' today', "
        "CASE WHEN id % 2000 = 0 THEN ' quixotry' ELSE '' END) AS text FROM range(22000) "
        "UNION ALL SELECT 30000 + id, 'zyzzogeton in copies' FROM range(30)"
    )


def test_words_of_all_documents_are_counted(large, monkeypatch):
    monkeypatch.setattr(secret_scan, "WORD_SHARE", 11 / 22001)
    assert secret_scan.corpus_words(large) == ["paid", "today", "quixotry"]
    monkeypatch.setattr(secret_scan, "WORD_SHARE", 11.5 / 22001)
    assert secret_scan.corpus_words(large) == ["paid", "today"]


def test_forest_learns_from_all_findings(large, monkeypatch):
    fitted = []
    monkeypatch.setattr(secret_scan.Forest, "fit_rows", lambda rows: fitted.append(rows.count()))
    secret_scan.train(large)
    assert fitted == [22_000 + len(secret_scan.form_rows())]


def test_pipeline_masks_by_words_and_findings_of_all_documents(spark, large, monkeypatch):
    judges = []
    monkeypatch.setattr(secret_scan, "WORD_SHARE", 11 / 22001)
    monkeypatch.setattr(secret_scan, "redact", lambda docs, judge: judges.append(judge))
    monkeypatch.setattr(secret_scan.Forest, "fit_rows", lambda rows: rows.count())
    corpus_pipeline.secrets(spark, large, "")
    words = judges[0].vocabulary.words
    assert "quixotry" in words and "zyzzogeton" not in words
    assert judges[0].forest == 22_000 + len(secret_scan.form_rows())


def test_one_pass_gives_the_findings_of_two(make_docs, odd_rows):
    docs = make_docs([*odd_rows, (20, "x token = 4f9c1b7e2a6d8035c7e1 y", "en", "a"), (21, "paid 4041894974608795 on", "en", "a")])
    once = sorted(map(tuple, secret_scan.train_and_scan(docs).collect()), key=str)
    assert once == sorted(map(tuple, secret_scan.scan(docs, secret_scan.train(docs)).collect()), key=str)
    assert {(r[0], r[5]) for r in once} == {(20, True), (21, False)}


def test_forest_does_not_depend_on_the_dealing(spark):
    rng = np.random.default_rng(3)
    x = rng.random((3000, 6)).round(2)
    y = (x[:, 1] + x[:, 4] > 1.2).astype(int)
    rows = [(int(k), int(label), v.tolist()) for k, label, v in zip(rng.integers(-(2**63), 2**63, len(x)), y, x, strict=True)]
    df = spark.createDataFrame(rows, "key long, label int, x array<double>")
    one, many = (forests.grow(stage(df.repartition(n)), 12, 5, 0.5, 1) for n in (1, 7))
    for a, b in ((one.feature, many.feature), (one.threshold, many.threshold), (one.leaf, many.leaf)):
        assert (a == b).all()
    local = secret_scan.Forest.fit(x, y.astype(float), 12, 5)
    fresh = rng.random((2000, 6))
    want = fresh[:, 1] + fresh[:, 4] > 1.2
    assert ((one.totals(fresh) >= 0.5) == want).mean() > ((local.score(fresh) >= 0.5) == want).mean() - 0.02
    assert ((one.totals(fresh) >= 0.5) == want).mean() > 0.92


def test_rare_values_have_a_threshold(spark):
    rows = [(k, int(k == 5), [1.0 if k != 5 else 0.0, k / 999]) for k in range(1000)]
    cuts = forests.edges(spark.createDataFrame(rows, "key long, label int, x array<double>"))
    assert cuts[0].tolist() == [0.0] and len(cuts[1]) == 63
