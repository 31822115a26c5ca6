"""Registered queries of the operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgrid.llm import (
    collocations, language, license_scan, line_rules, manifest, packing, piece_ids, quality, secret_scan, simhash, sketches, url_rules, vector_graph,
)
from hearthgrid.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


URL_SQL = r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host || path, '(?i)/robots\.txt$') THEN 'allow'
  WHEN regexp_matches(host || path, '(?i)^([^/]*\.)?(spam-farm|cheap-pills|casino|(?s:.*)-casino|free-(?s:.*)-money)\.')
    OR regexp_matches(host || path, '(?i)/wp-login\.php([^a-z0-9_.%\-]|$)|/porn/')
    OR regexp_matches(host || path, '(?i)([^a-z0-9_.%\-]|$)affiliate([^a-z0-9_.%\-]|$)(?s:.*)([^a-z0-9_.%\-]|$)click([^a-z0-9_.%\-]|$)')
  THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


@query("op8_url_filter", URL_SQL)
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL."""
    return url_rules.judge_urls(read(spark, sf_dir, "pages")).drop("pattern")


LINE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), windows AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM docs)
), again AS (
  SELECT rid, count(DISTINCT i + d) AS n_repeat_words
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows), (VALUES (0), (1), (2)) AS v(d)
  WHERE n > 1 GROUP BY rid
), lined AS (
  SELECT rid, host, text, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw
  FROM (SELECT rid, host, text, unnest(lines) AS line FROM docs)
), words AS (
  SELECT rid, host, text, line, len(lw) AS n, translate(array_to_string(lw, ' '),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS normal
  FROM lined WHERE len(lw) > 0
), dups AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM words GROUP BY rid
), hosts AS (
  SELECT host, count(DISTINCT text) AS n_docs FROM docs GROUP BY host
), frequent AS (
  SELECT host, normal FROM (SELECT host, normal, count(DISTINCT text) AS n FROM words GROUP BY ALL)
  JOIN hosts USING (host) WHERE n > 20 AND n > least(0.05 * n_docs, 1000)
), gone AS (
  SELECT rid, sum(n) AS removed_words FROM words JOIN frequent USING (host, normal) GROUP BY rid
), measured AS (
  SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
    len(coalesce(text, '')) - len(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(removed_words, 0) AS removed_words
  FROM docs LEFT JOIN again USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN gone USING (rid)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND n_words - removed_words >= 0.3 * n_words AS kept
FROM measured
"""


@query("op7_line_rules", LINE_SQL)
def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return line_rules.judge_documents(read(spark, sf_dir, "documents")).drop("clean_text")


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = read(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, read(spark, sf_dir, "labels")))


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of every document."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op4_piece_ids")
def op4_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_ids.encoding_digests(read(spark, sf_dir, "documents"), model)


@query("op1_language")
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = read(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


@query("op2_neighbours")
def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest rows of every twentieth embedding."""
    return vector_graph.nearest(read(spark, sf_dir, "embeddings"))


@query("op9_secrets")
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for secrets of every document, judged by the forest."""
    return secret_scan.train_and_scan(read(spark, sf_dir, "documents"))


@query("op5_licenses")
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and texts found in every document."""
    return license_scan.scan(read(spark, sf_dir, "documents"))


MANIFEST_SQL = r"""
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS rid, *, CASE WHEN text IS NULL THEN NULL ELSE
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS lowered,
    list_reduce(list_prepend(4294967295::UBIGINT, [ascii(c)::UBIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::UBIGINT FOR i IN range(8)]),
        lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)) AS crc
  FROM documents
), fields AS (
  SELECT rid, doc_id, source, text, coalesce(xor(crc, 4294967295::UBIGINT) % 5 = 0, false) AS tampered,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(lowered) || ':' || lowered, '-') AS changed
  FROM rows
), hashed AS (
  SELECT rid, doc_id, source, sha256(head || body) AS leaf,
    CASE WHEN tampered THEN sha256(head || changed) ELSE sha256(head || body) END AS tried
  FROM fields
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n
  FROM hashed
), up AS (
  SELECT source, 0 AS lvl, pos, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT source, lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM up WHERE n > 1 GROUP BY source, lvl, pos // 16, n
), subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS spos, count(*) OVER () AS m
  FROM up WHERE n = 1
), top AS (
  SELECT 0 AS lvl, spos AS pos, m AS n, subroot AS digest FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 16, n
), steps AS (
  SELECT l.rid, u.lvl AS lvl, u.pos, u.digest, u.pos = l.pos >> (4 * u.lvl) AS own
  FROM leaves l JOIN up u ON l.source IS NOT DISTINCT FROM u.source AND u.n > 1 AND u.pos >> 4 = l.pos >> (4 * u.lvl + 4)
  UNION ALL
  SELECT l.rid, 1000 + t.lvl, t.pos, t.digest, t.pos = s.spos >> (4 * t.lvl)
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
  JOIN top t ON t.n > 1 AND t.pos >> 4 = s.spos >> (4 * t.lvl + 4)
), proofs AS (
  SELECT rid, sha256(string_agg(digest, '' ORDER BY lvl, pos)) AS proof_sha256 FROM steps WHERE NOT own GROUP BY rid
), runs AS (
  SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY lvl) AS step,
    coalesce(string_agg(digest, '' ORDER BY pos) FILTER (WHERE pos < mine), '') AS before,
    coalesce(string_agg(digest, '' ORDER BY pos) FILTER (WHERE pos > mine), '') AS after
  FROM (SELECT *, max(pos) FILTER (WHERE own) OVER (PARTITION BY rid, lvl) AS mine FROM steps) GROUP BY rid, lvl
), folded AS (
  SELECT rid, 0 AS step, tried AS digest FROM leaves
  UNION ALL
  SELECT f.rid, f.step + 1, sha256(r.before || f.digest || r.after) FROM folded f JOIN runs r ON f.rid = r.rid AND r.step = f.step + 1
), ends AS (
  SELECT rid, arg_max(digest, step) AS folded_root FROM folded GROUP BY rid
)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
CROSS JOIN (SELECT digest AS root FROM top WHERE n = 1) JOIN ends USING (rid) LEFT JOIN proofs USING (rid)
"""


@query("op12_manifest", MANIFEST_SQL)
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, inclusion proof and verdict of every document."""
    return manifest.manifest_of(read(spark, sf_dir, "documents"))


@query("op13_fingerprints")
def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and of its edited text, and their likeness."""
    found = sketches.compare_with_next(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketches.digits(F.col("sketch")).alias("fingerprint"),
        sketches.digits(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


PHRASE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs)
), places AS (
  SELECT lang, w, len(w) AS m, unnest(generate_series(1, len(w))) AS i FROM pieces WHERE len(w) > 0
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM places, (VALUES (1), (2), (3), (4)) AS v(k) WHERE i + k - 1 <= m
), counts AS (
  SELECT lang, k AS words, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL
), sizes AS (
  SELECT lang, sum(f) AS n FROM counts WHERE words = 1 GROUP BY lang
), cands AS (
  SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE words > 1 AND f >= 30
), cuts AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, c.k, 2000000 * c.a // (x.f + y.f) AS score
  FROM (SELECT *, unnest(generate_series(1, words - 1)) AS k FROM cands) c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.k) = 1
), inner_counts AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, words, unnest(generate_series(1, words)) AS i FROM cands), (VALUES (2), (3)) AS v(k)
  WHERE k < words AND i + k - 1 <= words GROUP BY ALL
), kept AS (
  SELECT cuts.* FROM cuts LEFT JOIN inner_counts USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM placed JOIN sizes USING (lang) WHERE rank <= 2000
"""


@query("op11_collocations", PHRASE_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best collocations of every language."""
    return collocations.collocations(read(spark, sf_dir, "documents"))
