"""URL filters by rules that are indexed by their rarest literal token. DataFrame functions only.

Two kinds of rules:

* host rules, `host/path`: fit the host and all its subdomains if the URL's path starts with the
  rule's path; the longest fitting rule decides (ties: the smaller rule text);
* pattern rules: `||` anchors at a host label, `|` at either end, `*` is any run, `^` a separator
  or the end. They decide where no host rule fits, an exception (`@@`) before a block.

Both compile to one regular expression over `host + path`. Each rule is filed under that literal
token of its own that the fewest pages carry. A URL's tokens fetch candidate rules from the index,
an array of hash buckets that is a literal of the plan, and only candidates run their expression.
Nothing is shuffled but the token counts (one row for each token that a rule has).

More than MOST_RULES rules are a table instead, joined by token with the distinct pairs of host and
path; Spark broadcasts it only if it is small enough. The result is the same.

Defined cases: a null URL or one without `://` has an empty host and path, matches no rule and is
allowed; repeated rows stay repeated; an empty table gives an empty result; further input columns
are not looked at.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import ascii_lower

#: Host rules of the contract, and pattern rules of hosts and paths that are never training text.
HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
PATTERN_RULES = ("||spam-farm.", "||cheap-pills.", "/wp-login.", "/casino/", "@@||spam-farm.example.org/en/about^")
#: Rules that are a literal of the plan; more are a table.
MOST_RULES = 2_000


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    rank: int


def host_rule(text: str, verdict: str) -> Rule:
    """`rank` orders fitting rules: a host rule outranks any pattern rule, the longer the higher."""
    host, slash, path = text.partition("/")
    path = slash + path
    whole = [t for t in re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path.lower()) if t]
    end = "" if path else r"(?:/|\z)"
    return Rule(text, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}{end}", tuple(dict.fromkeys([*re.findall("[a-z0-9]+", host), *whole])), 1000 + len(text))


def pattern_rule(text: str) -> Rule:
    allow = text.startswith("@@")
    body = text.removeprefix("@@")
    head, body = (r"(?s)^(?:[^/]*\.)?", body[2:]) if body.startswith("||") else ("(?s)^", body[1:]) if body.startswith("|") else ("(?s)", body)
    tail, body = (r"\z", body[:-1]) if body.endswith("|") else ("", body)
    sign = {"*": ".*", "^": r"(?:[^a-z0-9_.%-]|\z)"}
    regex = "".join(sign.get(c) or re.escape(c) for c in body)
    # A token of the rule is a token of the URL too if nothing of the pattern can lengthen it.
    marked = ("\n" if "^" in head else "*") + body + ("\n" if tail else "*")
    tokens = re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", marked.lower())
    return Rule(text, "allow" if allow else "block", head + regex + tail, tuple(dict.fromkeys(tokens)), 1 + allow)


def rules_of(host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> list[Rule]:
    return [host_rule(*r) for r in host_rules] + [pattern_rule(p) for p in pattern_rules]


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    """The distinct runs of letters and digits, lower-cased."""
    return F.array_distinct(F.filter(F.split(ascii_lower(F.concat(host, path)), "[^a-z0-9]+"), lambda t: t != ""))


def rarity(tokens: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """How many rows carry each token of the rules; at most one row a token comes to the driver."""
    wanted = sorted({t for r in rules for t in r.tokens})
    found = tokens.select(F.explode("tokens").alias("token")).filter(F.col("token").isin(wanted)).groupBy("token").count().collect()
    return dict.fromkeys(wanted, 0) | {r["token"]: r["count"] for r in found}


def index_of(rules: list[Rule], counts: dict[str, int]) -> tuple[list[list[tuple]], list[tuple]]:
    """Hash buckets of (token, rule), and the rules that have no literal token."""
    size = 1 << max(4, (2 * len(rules)).bit_length())
    buckets, loose = [[] for _ in range(size)], []
    for r in rules:
        entry = (r.regex, r.rank, r.text, r.verdict)
        if r.tokens:
            token = min(r.tokens, key=lambda t: (counts[t], t))
            buckets[zlib.crc32(token.encode()) % size].append((token, *entry))
        else:
            loose.append(("", *entry))
    return buckets, loose


def _literal(entries: list[tuple]) -> Column:
    names = ("token", "regex", "rank", "text", "verdict")
    kind = "array<struct<token:string,regex:string,rank:int,text:string,verdict:string>>"
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, e, strict=True)]) for e in entries]).cast(kind)


def _fitting(entry: Column, subject: Column) -> Column:
    return F.regexp_like(subject, entry["regex"])


ENTRY = ("token", "regex", "rank", "text", "verdict")


def by_literal(base: DataFrame, rules: list[Rule]) -> DataFrame:
    """A column `fits`, the rules that fit: fetched from an array of hash buckets in the plan."""
    buckets, loose = index_of(rules, rarity(base.select("tokens"), rules))
    index = F.array(*[_literal(b) for b in buckets])
    subject = F.concat("host", "path")  # a host has no slash, a path starts with one
    fetched = F.flatten(F.transform("tokens", lambda t: F.filter(F.element_at(index, (F.crc32(t.cast("binary")) % len(buckets) + 1).cast("int")), lambda r: r["token"] == t)))
    return base.withColumn("fits", F.filter(F.concat(fetched, _literal(loose)), lambda r: _fitting(r, subject)))


def by_table(base: DataFrame, rules: list[Rule]) -> DataFrame:
    """The same column, fetched by joins with a table of rules; each distinct host and path is judged once."""
    spark = base.sparkSession
    of = [(i, t) for i, r in enumerate(rules) for t in r.tokens]
    wanted = spark.createDataFrame(of, "rule int, token string")
    distinct = base.select("host", "path", "tokens").dropDuplicates(["host", "path"])
    seen = base.select(F.explode("tokens").alias("token")).groupBy("token").count()
    rarest = wanted.join(seen, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    table = spark.createDataFrame([(i, r.regex, r.rank, r.text, r.verdict) for i, r in enumerate(rules)], "rule int, regex string, rank int, text string, verdict string")
    filed = table.join(rarest, "rule").select(F.struct(*ENTRY).alias("entry"), "token")
    loose = _literal([("", r.regex, r.rank, r.text, r.verdict) for r in rules if not r.tokens])
    subject = F.concat("host", "path")
    hits = distinct.select("host", "path", F.explode("tokens").alias("token")).join(filed, "token").filter(_fitting(F.col("entry"), subject)).groupBy("host", "path").agg(F.collect_list("entry").alias("found"))
    none = F.array().cast("array<struct<token:string,regex:string,rank:int,text:string,verdict:string>>")
    return base.join(hits, ["host", "path"], "left").withColumn("fits", F.concat(F.coalesce("found", none), F.filter(loose, lambda r: _fitting(r, subject)))).drop("found")


def judge(pages: DataFrame, url: str = "url", host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """Add host, path, host_rule, pattern_rule and verdict to each row."""
    rules = rules_of(host_rules, pattern_rules)
    taken = set(pages.columns)
    mine = {"host", "path", "tokens", "fits", "host_rule", "pattern_rule", "verdict"}
    base = pages.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(pages.columns)], F.col(f"`{url}`").alias("link"))
    base = base.select("*", host_of(F.col("link")).alias("host"), path_of(F.col("link")).alias("path"))
    base = base.select("*", tokens_of(F.col("host"), F.col("path")).alias("tokens"))
    base = by_literal(base, rules) if len(rules) <= MOST_RULES else by_table(base, rules)
    best = lambda test: F.array_min(F.transform(F.filter("fits", test), lambda r: F.struct((-r["rank"]).alias("rank"), r["text"].alias("text"), r["verdict"].alias("verdict"))))
    base = base.select("*", best(lambda r: r["rank"] >= 1000).alias("h"), best(lambda r: r["rank"] < 1000).alias("p"))
    keep = [F.col(f"in_{i}").alias(c) for i, c in enumerate(pages.columns) if c not in mine or c not in taken]
    return base.select(*keep, "host", "path", F.col("h.text").alias("host_rule"), F.col("p.text").alias("pattern_rule"), F.coalesce("h.verdict", "p.verdict", F.lit("allow")).alias("verdict"))
