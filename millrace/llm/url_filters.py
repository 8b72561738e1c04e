"""URL rules, found by their rarest literal token.

A rule's pattern is a regular expression over host and path. Words that every match must
hold as whole tokens are its literals; the rule is filed under the literal that the fewest
urls hold, as counted over the table. A url's tokens fetch its candidate rules,
and only those run their expressions. Rules without a literal run on every url.

Null urls and those without ``://`` have an empty host and path, which no host rule fits. Repeated
rows get equal verdicts, an empty table gives an empty table, and other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN_BREAK = "[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``listed`` rules name a host and path and win by length; the others are general patterns."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    listed: bool = False

    @property
    def host_length(self) -> int:
        return self.name.find("/") if self.listed else 0


def host_rule(verdict: str, name: str) -> Rule:
    """A rule for ``host/path``, its subdomains, and whatever continues the path."""
    host, _, path = name.partition("/")
    quoted = "".join(x if re.fullmatch(r"[\w/-]", x, re.ASCII) else f"\\{x}" for x in f"{host.translate(str.maketrans(UPPER, LOWER))}/{path}")
    tokens = re.split(TOKEN_BREAK, f"{host}/{path}".translate(str.maketrans(UPPER, LOWER)))
    return Rule(name, verdict, rf"^(?:[^/]*\.)?{quoted}", tuple(t for t in tokens[:-1] if t), listed=True)


def path_rule(verdict: str, name: str, word: str) -> Rule:
    """A rule for a whole ``word`` anywhere in the path."""
    return Rule(name, verdict, rf"/(?:[^/]*[^A-Za-z0-9/])?{word}(?:[^A-Za-z0-9]|$)", (word,))


def label_rule(verdict: str, name: str, word: str) -> Rule:
    """A rule for a whole ``word`` in the host."""
    return Rule(name, verdict, rf"^(?:[^/]*[^a-z0-9/])?{word}(?:[^a-z0-9/][^/]*)?(?:/|$)", (word,))


LISTED = (
    host_rule("allow", "org/"),
    host_rule("block", "example.org/es/"),
    host_rule("block", "example.org/en/1"),
    host_rule("allow", "com/fr/"),
    host_rule("block", "com/de/"),
)
GENERAL = (
    *(path_rule("block", f"page of {w}", w) for w in ("login", "signup", "cart", "checkout", "admin", "search")),
    *(label_rule("block", f"host of {w}", w) for w in ("ads", "tracker", "casino", "porn", "doubleclick")),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, in lower case, and path; both empty where there is no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def _tokens(subject: Column) -> Column:
    return F.array_distinct(F.split(F.translate(subject, UPPER, LOWER), TOKEN_BREAK))


def literal_counts(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """How many urls hold each literal: counted over all urls, returned for the literals of the rules alone."""
    wanted = sorted({t for rule in rules for t in rule.literals})
    held = F.array_intersect(F.col("tokens"), F.lit(wanted).cast("array<string>"))
    return {r["token"]: r["n"] for r in urls.select(F.explode(held).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def _index(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[list[list[dict]], list[int]]:
    """Buckets of (token, rules filed under it), and the rules without a literal."""
    filed, always = defaultdict(list), []
    for i, rule in enumerate(rules):
        if rule.literals:
            filed[min(rule.literals, key=lambda t: (counts.get(t, 0), t))].append(i)
        else:
            always.append(i)
    buckets: list[list[dict]] = [[] for _ in range(max(1, len(filed)))]
    for token, held in sorted(filed.items()):
        buckets[zlib.crc32(token.encode()) % len(buckets)].append({"token": token, "rules": held})
    return buckets, always


def _constant(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def judge_urls(pages: DataFrame, listed: tuple[Rule, ...] = LISTED, general: tuple[Rule, ...] = GENERAL, default: str = "allow") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` for each page, without a shuffle of pages.

    The longest listed rule decides, then the longest name among the general rules, then ``default``.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = parts.withColumn("subject", F.concat("host", "path")).withColumn("tokens", _tokens(F.col("subject")))
    rules = (*listed, *general)
    buckets, always = _index(rules, literal_counts(urls, rules))
    table = _constant(
        [{"name": r.name, "verdict": r.verdict, "pattern": r.pattern, "rank": [int(r.listed), len(r.name), r.host_length], "listed": r.listed} for r in rules],
        "array<struct<name:string,verdict:string,pattern:string,rank:array<int>,listed:boolean>>",
    )
    index = _constant(buckets, "array<array<struct<token:string,rules:array<int>>>>")

    def fetched(token: Column) -> Column:
        bucket = F.element_at(index, (F.crc32(token) % len(buckets) + 1).cast("int"))
        return F.flatten(F.transform(F.filter(bucket, lambda e: e["token"] == token), lambda e: e["rules"]))

    candidates = F.concat(F.flatten(F.transform("tokens", fetched)), F.lit(always).cast("array<int>"))
    ranked = lambda r: F.struct(r["rank"].alias("rank"), r["name"].alias("name"), r["verdict"].alias("verdict"), r["listed"].alias("listed"))
    chosen = (
        urls.withColumn("candidates", F.transform(candidates, lambda i: F.element_at(table, i + 1)))
        .withColumn("fitting", F.filter("candidates", lambda r: F.regexp_like(F.col("subject"), r["pattern"])))
        .withColumn("best", F.array_max(F.transform("fitting", ranked)))
    )
    return chosen.select(
        "page_id", "host", "path", F.when(F.col("best.listed"), F.col("best.name")).alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
