"""URL filters: pattern rules indexed by their rarest literal token (operator 1, native).

A rule is an action with a host and a path pattern. It fits a URL whose host is the rule's or a subdomain of it and whose
path starts with the rule's; `*` in a rule's path stands for any characters. Every rule is filed under one of its literal
tokens, the one that fewest rules have: a host label (`h:org`) or a whole path segment (`p:es`). The tokens of a URL fetch
the candidate rules, and regular expressions run for those only. A rule without a literal token is filed under a token that
every URL has.

Up to MAX_INLINE rules, the index is a constant of the plan, an array of hash buckets; a URL is judged in its own row and
nothing is shuffled. Beyond that, the tokens of the distinct URLs are joined with the index table.

Defined cases: a null URL, or one without `://`, has an empty host and path and no rule fits; a URL without a path has the
empty path; of several fitting rules the longest (host and path together) wins, then block before allow, then the greater
rule string; repeated rows are judged each; an empty table gives an empty result; other columns of the input pass through
unless they bear the name of a result column, in which case they are replaced.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Rules held as a constant in the plan (about 200 bytes each, so 4 MB at most); more are joined.
MAX_INLINE = 20_000
EVERY = "*"
ENTRY = "struct<token:string,size:int,action:string,rule:string,regex:string>"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        path = ".*".join(re.escape(x) for x in self.path.split("*"))
        return rf"(?s)^(?:[^/]*\.)?{re.escape(self.host)}(?=/|$){path}" if self.host else rf"(?s)^[^/]*{path}"

    def tokens(self) -> list[str]:
        """Tokens that every fitting URL has; the last path segment of a prefix may go on in the URL, so it is none."""
        segments = [x for x in self.path.split("/")[1:-1] if x and "*" not in x]
        return [f"h:{x}" for x in self.host.split(".") if x] + [f"p:{x}" for x in segments]


def index(rules: list[Rule]) -> list[dict]:
    """One entry per rule, under its rarest token (ties: the smaller token)."""
    often = Counter(t for r in rules for t in set(r.tokens()))
    return [
        {"token": min(r.tokens(), key=lambda t: (often[t], t), default=EVERY), "size": len(r.text), "action": r.action, "rule": r.text, "regex": r.regex}
        for r in dict.fromkeys(rules)
    ]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return lower_ascii(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments, F.array(F.lit(EVERY))))


def _best(entries: Column) -> Column:
    """Longest, then block, then the greater rule."""
    return F.array_max(F.transform(entries, lambda e: F.struct(e["size"].alias("size"), e["action"].alias("action"), e["rule"].alias("rule"))))


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", max_inline: int = MAX_INLINE) -> DataFrame:
    """pages with host, path, rule and verdict; see the module."""
    if default not in ("allow", "block") or any(r.action not in ("allow", "block") for r in rules):
        raise ValueError("actions are allow and block")
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    if url not in kept:
        raise ValueError(f"the url column can't be named {url}")
    entries = index(rules)
    if len(entries) > max_inline:
        return _judge_joined(pages.select(*kept), entries, url, default)
    n = max(1, len(entries))
    buckets: list[list[dict]] = [[] for _ in range(n)]
    for e in entries:
        buckets[zlib.crc32(e["token"].encode()) % n].append(e)
    table = F.from_json(F.lit(json.dumps(buckets)), f"array<array<{ENTRY}>>")
    host, path = url_parts(F.col(url))
    df = pages.select(*kept, host.alias("host"), path.alias("path"))
    # the candidates of a token: those of its bucket that are filed under it
    fetched = F.flatten(
        F.transform(
            url_tokens(F.col("host"), F.col("path")),
            lambda t: F.filter(F.get(table, F.pmod(F.crc32(F.encode(t, "UTF-8")), F.lit(n)).cast("int")), lambda e: e["token"] == t),
        )
    )
    subject = F.concat("host", "path")
    df = df.withColumn("__best", _best(F.filter(fetched, lambda e: F.rlike(subject, e["regex"]))))
    return df.select(*kept, "host", "path", F.col("__best.rule").alias("rule"), F.coalesce("__best.action", F.lit(default)).alias("verdict"))


def _judge_joined(pages: DataFrame, entries: list[dict], url: str, default: str) -> DataFrame:
    """The same over an index too large for the plan: distinct URLs, their tokens joined with the index."""
    table = pages.sparkSession.createDataFrame(entries, ENTRY[7:-1].replace(":", " "))
    host, path = url_parts(F.col("__url"))
    urls = pages.select(F.col(url).alias("__url")).where(F.col("__url").isNotNull()).distinct().select("__url", host.alias("__host"), path.alias("__path"))
    tokens = urls.select("*", F.explode(url_tokens(F.col("__host"), F.col("__path"))).alias("token"))
    hits = tokens.join(table, "token").where(F.rlike(F.concat("__host", "__path"), F.col("regex")))
    best = hits.groupBy("__url").agg(F.max(F.struct("size", "action", "rule")).alias("__best"))
    host, path = url_parts(F.col(url))
    df = pages.join(best, pages[url] == best["__url"], "left")
    return df.select(*[pages[c] for c in pages.columns], host.alias("host"), path.alias("path"), F.col("__best.rule").alias("rule"), F.coalesce("__best.action", F.lit(default)).alias("verdict"))
