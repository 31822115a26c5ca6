"""Rules on URLs and lines, quality classifier."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from llm_documents import make_docs, odd_rows  # noqa: F401
from pyspark.sql import functions as F

from hearthgrid.llm import line_rules, quality, url_rules
from hearthgrid.llm.queries import ORACLES, QUERIES
from hearthgrid.llm.trees import FlatTrees, Histograms

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op7_line_rules", "op8_url_filter"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    cur = con.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, cur.fetchall()))


def test_url_rules_and_patterns(spark):
    urls = [
        "http://a.example.com/en/x?q#f", "http://www.example.com/en/x", "https://x.WWW.example.com/en/", "http://notexample.com/en/",
        "ftp://z.net/es/1", "ftp://z.net/es", "http://com", "http://com/", "http://spam-farm.example.org/", "http://my-spam-farm.org/x",
        "http://x.org/wp-login.php?x", "http://x.org/wp-login.phpx", "http://x.org/a/affiliate/b/click/", "no scheme", "", None,
        "http://spam-farm.example.org/robots.txt", "http://h:80/p", "http://a.example.com/en/://x",
    ]
    rows = [(None if i == 3 else i, u, "h", "v") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = {r.page_id: r for r in url_rules.judge_urls(pages.unionByName(pages)).collect()}
    assert len(url_rules.judge_urls(pages.unionByName(pages)).collect()) == 2 * len(urls)
    rules = {i: (r.rule, r.verdict) for i, r in got.items()}
    assert rules == {
        0: ("example.com/en/", "block"), 1: ("www.example.com/en/", "allow"), 2: ("www.example.com/en/", "allow"),
        None: ("com/", "allow"), 4: ("net/es/", "block"), 5: (None, "allow"), 6: (None, "allow"), 7: ("com/", "allow"),
        8: (None, "block"), 9: (None, "allow"), 10: (None, "block"), 11: (None, "allow"), 12: (None, "block"),
        13: (None, "allow"), 14: (None, "allow"), 15: (None, "allow"), 16: (None, "allow"), 17: (None, "allow"),
        18: ("example.com/en/", "block"),
    }
    assert (got[17].host, got[17].path, got[15].host, got[0].path) == ("h:80", "/p", "", "/en/x")
    assert got[18].path == "/en/://x"
    assert url_rules.judge_urls(pages.limit(0)).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    subjects = spark.createDataFrame([(["", "en", "com"],), (["", "com"],), (["", "rare", "com"],)], "tokens array<string>")
    index, slots = url_rules.rule_index(subjects, [("block", "rare.com/en/"), ("block", "com/")], [])
    flat = spark.range(1).select(F.flatten(index).alias("r")).first().r
    # neither "en" nor "rare" is rarer; the name decides
    assert {r.rule: r.token for r in flat} == {"rare.com/en/": "en", "com/": "com"}
    assert slots == 4
    assert url_rules.pattern_tokens("||*-casino.") == ["casino"]
    assert url_rules.pattern_tokens("||free-*-money.") == ["free", "money"]
    assert url_rules.pattern_tokens("spam") == []


def naive_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if count[w] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dups = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(covered)


def test_measures_equal_a_naive_count():
    rng = np.random.default_rng(1)
    texts = ["", "a", "a a a a", "x\x85y z w", "a b c a b c\n\n a\n a", "# $ |"]
    texts += ["".join(rng.choice(list("ab \n#"), 60)) for _ in range(200)]
    assert [line_rules.measure(t) for t in texts] == [naive_measures(t) for t in texts]


def test_line_rules_remove_boilerplate_and_reject_depleted(make_docs, odd_rows):
    body = " ".join(f"word{i}" for i in range(60))
    rows = [(100 + i, f"{body} {i}\nShared  LINE here\n{i} end", "en", "a") for i in range(30)]
    # little but boilerplate
    shared = "\n".join(["shared line here " * 1] * 20)
    rows += [(200, shared + "\n" + " ".join(f"u{i}" for i in range(20)), "en", "a")]
    # copies of one text count as one document of a line
    rows += [(300 + i, f"{body} copies of one text", "en", "c") for i in range(40)]
    docs = make_docs(rows + odd_rows)
    got = {r.doc_id: r for r in line_rules.judge_documents(docs).collect()}
    assert got[100].removed_words == 3 and got[100].kept and "Shared" not in got[100].clean_text
    assert got[200].removed_words == 60 and not got[200].base_failed is None and not got[200].kept
    assert got[300].removed_words == 0 and got[300].kept
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept and got[1].clean_text is None
    assert got[5].n_words == 280_000 and got[5].base_failed
    assert line_rules.judge_documents(docs).count() == len(rows + odd_rows)
    kept = line_rules.filter_documents(docs)
    assert kept.columns == docs.columns
    by_id = {r.doc_id: r for r in kept.collect()}
    assert set(by_id) == {i for i, r in got.items() if r.kept}
    assert by_id[100].n_chars == len(by_id[100].text) and by_id[100].lines == "y"
    assert line_rules.judge_documents(docs.limit(0)).count() == 0
    assert line_rules.filter_documents(docs.limit(0)).count() == 0


def test_quality_on_held_out_rows(spark):
    scored = QUERIES["op10_quality"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = scored.join(labels, "doc_id").where("held_out").select("predicted", "quality", "score").collect()
    assert len(rows) > 50
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert scored.count() == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()


def test_quality_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 1), (9, 1), (None, 0), (5, None), (6, 3)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score_documents(docs, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [True, True]
    nobody = quality.train(docs.limit(0), labels.limit(0))
    assert {r.score for r in quality.score_documents(docs, nobody).collect()} == {0.5}
    assert quality.score_documents(docs.limit(0), model).count() == 0
    assert quality.filter_documents(docs, nobody).count() == len(odd_rows)


def test_held_out_rows_teach_nothing(spark, make_docs):
    docs = make_docs([(i, "good text " * (i % 7 + 1), "en", "a") for i in range(60)])
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    other = docs.select("doc_id", F.when(quality.held_out(), 1 - F.col("doc_id") % 2).otherwise(F.col("doc_id") % 2).cast("int").alias("quality"))
    a, b = (quality.train(docs, x) for x in (labels, other))
    assert np.array_equal(a.trees.leaf, b.trees.leaf) and a.base == b.base


def test_flat_trees_equal_a_walk_down():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.fit_trees(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.97

    def walk(row):
        total = model.base
        for f, t, leaf in zip(model.trees.feature, model.trees.threshold, model.trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x[:50]), [walk(r) for r in x[:50]])
    empty = FlatTrees.empty(0, 3)
    assert empty.totals(x).tolist() == [0.0] * 400
    assert Histograms(np.ones((5, 2))).edges[0].tolist() == [1.0]
