"""URL filters: pattern rules found through their rarest literal token.

Host rules (host, path prefix) decide first; the longest that fits wins.  All
other urls go through pattern rules: each rule is indexed under the one of its
literal tokens that the fewest urls hold, or under one for each of its branches, the tokens of a url fetch candidate
rules from that index, and only those candidates run their regular expression.
Everything is DataFrame functions.

A null url, or one without ``://``, has an empty host and path, fits no host
rule and is allowed unless a pattern blocks it (null: allowed).  Repeated rows
give repeated results, an empty table an empty one; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class HostRule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


class PatternRule(NamedTuple):
    """A blocking pattern over the lower-cased url.

    Every match holds all ``tokens`` as whole [a-z0-9]+ tokens, and one of ``branches`` if there are any.
    """

    pattern: str
    tokens: tuple[str, ...]
    branches: tuple[str, ...] = ()


def _label(name: str) -> PatternRule:
    return PatternRule(f"://([^/?#]*[.])?{name}[.]", tuple(name.split("-")))


#: Sites that advertise, gamble, sell pills or show adult pictures.
PATTERNS = [_label(x) for x in ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")] + [
    PatternRule("://([^/?#]*[.])?(porn|xxx)[.-]", (), ("porn", "xxx")),
    PatternRule("/wp-login[.]php", ("wp", "login", "php")),
]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return lower_ascii(F.coalesce(F.regexp_extract(url, form, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, form, 2), F.lit(""))


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(url, F.lit("([a-z0-9]+)"), F.lit(1)))


def rarest_tokens(urls: DataFrame, rules: Sequence[PatternRule]) -> list[str | None]:
    """For each rule, its token that the fewest urls hold (ties: the first in order); None without tokens.

    What reaches the driver is a count for each token of the rules.
    """
    spark = urls.sparkSession
    wanted = sorted({t for r in rules for t in r.tokens})
    seen = {}
    if wanted:
        known = spark.createDataFrame([(t,) for t in wanted], "token string")
        found = urls.select(F.explode(_tokens(F.col("url"))).alias("token")).join(F.broadcast(known), "token")
        seen = {r["token"]: r["count"] for r in found.groupBy("token").count().collect()}
    return [min(r.tokens, key=lambda t: (seen.get(t, 0), t)) if r.tokens else None for r in rules]


def index_tokens(keys: Sequence[str | None], rules: Sequence[PatternRule]) -> list[tuple[str, ...]]:
    """For each rule, the tokens that fetch it; none if it must run over every url."""
    return [(k,) if k else r.branches for k, r in zip(keys, rules)]


def judge_urls(
    pages: DataFrame, host_rules: Sequence[HostRule], patterns: Sequence[PatternRule] = PATTERNS,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    The rules are parameters, so their index is of the size of the call's
    arguments; it is the only thing broadcast.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    judged = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(host_rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit(f".{r.host}"))) & F.startswith("path", F.lit(r.path))
        rule, verdict = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    judged = judged.withColumns({"rule": rule, "ruled": verdict})

    urls = judged.where("rule is null and url is not null").select("url", lower_ascii(F.col("url")).alias("low"))
    keys = rarest_tokens(urls.select(F.col("low").alias("url")), patterns)
    fetch = index_tokens(keys, patterns)
    index = spark.createDataFrame([(t, r.pattern) for own, r in zip(fetch, patterns) for t in own], "token string, pattern string")
    hits = (
        urls.select("url", "low", F.explode(_tokens(F.col("low"))).alias("token"))
        .join(F.broadcast(index), "token").where("low rlike pattern").select("url")
    )
    always = [r.pattern for own, r in zip(fetch, patterns) if not own]  # no literal token in any match
    if always:
        hits = hits.union(urls.where(reduce(or_, [F.col("low").rlike(p) for p in always])).select("url"))
    blocked = hits.distinct().withColumn("hit", F.lit(True))
    return judged.join(blocked, "url", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("rule").isNull() & F.col("hit"), "block"), F.lit("allow")).alias("verdict"),
    )
