"""URL filter: pattern rules indexed by their rarest literal token.

Rules are written in the usual filter syntax: ``||`` anchors at a domain label, ``*`` stands
for anything, ``^`` for a separator. Every rule is filed under the one of its literal tokens
that the fewest URLs hold. A URL's tokens fetch the rules filed under them, and only those
rules run their regular expression. Only DataFrame functions are used; a URL is judged inside its own row,
so there is no shuffle but the small count of rule tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthgrid.llm.common import LOWER, UPPER

# The site rules to apply, as (verdict, host and path).
SITE_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Patterns for URLs without a site rule, as (verdict, pattern). An allowing pattern beats a blocking one.
PATTERNS = (
    ("block", "||spam-farm."),
    ("block", "||cheap-pills."),
    ("block", "||casino."),
    ("block", "||*-casino."),
    ("block", "||free-*-money."),
    ("block", "/wp-login.php^"),
    ("block", "^affiliate^*^click^"),
    ("block", "/porn/"),
    ("allow", "/robots.txt|"),
)
RULE_TYPE = "array<array<struct<token:string,regex:string,site:boolean,verdict:string,rule:string,size:int>>>"
TOKEN = "([a-z0-9]+)"
SEPARATOR = r"(?:[^A-Za-z0-9_.%\-]|$)"


def pattern_regex(pattern: str, ignore_case: bool) -> str:
    """Regular expression of a pattern, to be searched in host and path."""
    body, start, end = pattern, "", ""
    if body.startswith("||"):
        body, start = body[2:], r"^(?:[^/]*\.)?"
    elif body.startswith("|"):
        body, start = body[1:], "^"
    if body.endswith("|"):
        body, end = body[:-1], "$"
    parts = {"*": "(?s:.*)", "^": SEPARATOR}
    middle = "".join(parts.get(c) or re.sub(r"([^A-Za-z0-9_/\-])", r"\\\1", c) for c in body)
    return ("(?i)" if ignore_case else "") + start + middle + end


def pattern_tokens(pattern: str) -> list[str]:
    """Tokens that every matching URL holds whole: runs between literal separators or anchors."""
    body = pattern.lower()
    found = []
    for m in re.finditer("[a-z0-9]+", body):
        before, after = body[: m.start()], body[m.end() :]
        # a wildcard or an open end may go on with more letters
        if before and before[-1] != "*" and after and after[0] != "*":
            found.append(m[0])
    return sorted(set(found))


def host_of(url: Column) -> Column:
    """Host in lower case; empty without ``://``."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Path up to the query or fragment; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(subject: Column) -> Column:
    tokens = F.regexp_extract_all(F.lower(subject), F.lit(TOKEN), F.lit(1))
    # the empty token fetches rules without any literal token
    return F.array_distinct(F.concat(F.array(F.lit("")), tokens))


def rule_index(
    subjects: DataFrame, rules: Sequence[tuple[str, str]], patterns: Sequence[tuple[str, str]]
) -> tuple[Column, int]:
    """Hash table of the rules as a literal, keyed by each rule's rarest token in ``subjects``.

    ``subjects`` has one column ``tokens``. At most one count per rule token comes to the driver, where the
    rules themselves were given.
    """
    entries = [
        (f"||{text}", True, verdict, text) for verdict, text in rules
    ] + [(text, False, verdict, text) for verdict, text in patterns]
    tokens = {p: pattern_tokens(p) for p, _, _, _ in entries}
    wanted = sorted({t for ts in tokens.values() for t in ts})
    # only tokens of rules are exploded
    held = subjects.select(
        F.explode(F.array_intersect("tokens", F.array(*map(F.lit, wanted)))).alias("token")
    ) if wanted else None
    counts = {r.token: r.n for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()} if held else {}
    filed = []
    for pattern, site, verdict, text in entries:
        rarest = min(tokens[pattern], key=lambda t: (counts.get(t, 0), t), default="")
        filed.append(
            {
                "token": rarest, "regex": pattern_regex(pattern, not site), "site": site,
                "verdict": verdict, "rule": text, "size": len(text),
            }
        )
    slots = max(1, 2 * len(filed))
    # Spark places the rules, so that the table and the look-up hash alike
    spark = subjects.sparkSession
    names = sorted({r["token"] for r in filed})
    places = spark.createDataFrame([(n,) for n in names] or [("",)], "token string").select(
        "token", F.pmod(F.xxhash64("token"), F.lit(slots)).cast("int").alias("slot")
    )
    slot_of = {r.token: r.slot for r in places.collect()}
    table: list[list[dict]] = [[] for _ in range(slots)]
    for r in filed:
        table[slot_of[r["token"]]].append(r)
    return F.from_json(F.lit(json.dumps(table)), RULE_TYPE), slots


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = SITE_RULES,
    patterns: Sequence[tuple[str, str]] = PATTERNS,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, pattern`` of every row of ``pages`` (``page_id, url``).

    ``rule`` is the longest site rule that fits host and path (ties: the greater text), NULL if none does. Without one,
    the patterns decide: ``pattern`` is the deciding one, and a URL that no pattern fits is allowed.
    A NULL url or one without ``://`` has an empty host and path and so fits no rule: it is allowed.
    Repeated rows and NULL ids keep one output row each; an empty table gives an empty
    result; other columns are ignored.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    subject = F.concat("host", "path")
    index, slots = rule_index(urls.select(url_tokens(subject).alias("tokens")), rules, patterns)

    def fetch(token: Column) -> Column:
        slot = F.element_at(index, (F.pmod(F.xxhash64(token), F.lit(slots)) + 1).cast("int"))
        return F.filter(slot, lambda r: r["token"] == token)

    candidates = F.flatten(F.transform(url_tokens(subject), fetch))
    hits = urls.withColumn("hits", F.filter(candidates, lambda r: F.rlike(subject, r["regex"])))

    def best(site: bool, allow: bool | None = None) -> Column:
        chosen = F.filter(
            "hits",
            lambda r: (r["site"] == site) & (F.lit(True) if allow is None else (r["verdict"] == "allow") == allow),
        )
        return F.array_max(F.transform(chosen, lambda r: F.struct(r["size"], r["rule"], r["verdict"])))

    ruled = hits.select(
        "page_id", "host", "path", best(True).alias("site"),
        F.coalesce(best(False, True), best(False, False)).alias("other"),
    )
    return ruled.select(
        "page_id", "host", "path",
        F.col("site.rule").alias("rule"),
        F.coalesce("site.verdict", "other.verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("site").isNull(), F.col("other.rule")).alias("pattern"),
    )
