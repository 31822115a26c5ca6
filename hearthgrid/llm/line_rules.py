"""Quality rules: document measures and the frequency of lines across the documents of a host.

A line of a host is boilerplate if it stands in more than ``MIN_DOCS`` documents and in more than
``MAX_SHARE`` of the host's documents, or in more than ``MAX_DOCS`` documents. Boilerplate lines are removed, and a document of which little is left is
rejected. Documents are told apart by their text, so exact copies of one text count once.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthgrid.llm.common import ASCII_LOWER, LOWER, UPPER, WORD, edit_structs, map_rows
from hearthgrid.session import stage

MIN_DOCS = 20
MAX_SHARE = 0.05
#: So many documents are enough in a host of any size.
MAX_DOCS = 1000
#: A document is depleted if less than this share of its words is left.
MIN_LEFT = 0.3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

WORDS = re.compile(WORD)
SYMBOLS = re.compile(r"[#*$%&|<>]")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULT = pa.schema(
    [("doc_id", pa.int64()), *((m, pa.int64()) for m in MEASURES), ("removed_words", pa.int64()),
     ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("clean_text", pa.string())]
)


def normal_line(line: Column) -> Column:
    """Lower-cased words joined by single spaces."""
    return F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), r"[\x20\x09-\x0D]+", " "))


def line_hash(line: str) -> int:
    """The signed hash that Spark gives the normal form of ``line``."""
    h = xxhash.xxh64_intdigest(" ".join(WORDS.findall(line.translate(ASCII_LOWER))).encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def host_lines(docs: DataFrame) -> DataFrame:
    """``host, text_key, line`` for every different line of every document; lines are hashes."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), normal_line), lambda x: x != "")
    return docs.select(
        F.coalesce("source", F.lit("")).alias("host"),
        F.xxhash64("text").alias("text_key"),
        F.explode(F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))).alias("line"),
    )


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """``host, lines``: the boilerplate of every host that has any.

    Counting different documents goes by (host, line, document) first, so the rows of a line that a third of all documents
    hold are spread over all tasks. A host has at most ``lines per document * documents / max(min_docs, min(max_share * documents,
    MAX_DOCS))`` such lines.
    """
    held = host_lines(docs).groupBy("host", "line").agg(F.count_distinct("text_key").alias("n"))
    sizes = docs.where(F.col("text").isNotNull()).groupBy(F.coalesce("source", F.lit("")).alias("host")).agg(
        F.count_distinct(F.xxhash64("text")).alias("n_docs")
    )
    often = held.where(F.col("n") > min_docs).join(sizes, "host").where(
        F.col("n") > F.least(max_share * F.col("n_docs"), F.lit(MAX_DOCS))
    )
    return often.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def repeated_words(words: list[str]) -> int:
    """Words inside a 3-word window that occurs at least twice, all occurrences counted."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    covered = bytearray(len(words))
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            covered[i : i + 3] = covered[j : j + 3] = b"\1\1\1"
    return sum(covered)


def measure(text: str) -> tuple[int, int, int, int, int]:
    """The five counts of :data:`MEASURES`."""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        len(SYMBOLS.findall(text)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def base_failure(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def remove_lines(text: str, frequent: set[int]) -> tuple[str, int]:
    """``text`` without its frequent lines, and the number of words that went."""
    left, removed = [], 0
    for line in text.split("\n"):
        if line and line_hash(line) in frequent:
            removed += len(WORDS.findall(line))
        else:
            left.append(line)
    return "\n".join(left), removed


def verdict(text: str | None, lines: list[int] | None) -> tuple[tuple[int, ...], int, bool, bool, str | None]:
    """Measures, removed words, base failure, whether the document stays, and its text without frequent lines."""
    counts = measure(text or "")
    clean, removed = remove_lines(text, set(lines)) if text and lines else (text, 0)
    failed = base_failure(counts[0], counts[4])
    return counts, removed, failed, not failed and counts[0] - removed >= MIN_LEFT * counts[0], clean


def judge_rows(ids, texts, frequent):
    for doc_id, text, lines in zip(ids, texts, frequent, strict=True):
        counts, *rest = verdict(text, lines)
        yield doc_id, *counts, *rest


def filter_rows(texts, frequent):
    found = [verdict(t, lines) for t, lines in zip(texts, frequent, strict=True)]
    return [f[3] for f in found], [f[4] for f in found]


def with_lines(docs: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """``doc`` (all columns of ``docs``) and ``lines``, the boilerplate of its host.

    The table of boilerplate is written first, so the planner broadcasts it only by its measured size.
    """
    frequent = stage(frequent_lines(docs, min_docs, max_share), "frequent-lines")
    rows = docs.select(F.struct("*").alias("doc"), F.coalesce("source", F.lit("")).alias("host"))
    return rows.join(frequent, "host", "left").select("doc", "lines")


def judge_documents(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """Measures, verdict and cleaned text of every row of ``docs`` (``doc_id, text, source``).

    A NULL text has no words, fails the base rules and keeps a NULL ``clean_text``; NULL sources form one host.
    Repeated rows keep one output row each, and as copies of one text they count as one
    document of a line. An empty table gives an empty result; other columns are ignored.
    """
    rows = with_lines(docs.select("doc_id", "text", "source"), min_docs, max_share)
    return map_rows(rows.select("doc.doc_id", "doc.text", "lines"), judge_rows, RESULT)


def filter_documents(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """The rows of ``docs`` that :func:`judge_documents` keeps, with their cleaned texts and all their columns."""
    rows = with_lines(docs, min_docs, max_share)
    return edit_structs(rows, docs, filter_rows)
