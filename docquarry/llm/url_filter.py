"""URL filters: pattern rules indexed by their rarest literal token.

Every rule names literal tokens that any URL it matches must hold. Counts over the URLs tell each rule's rarest
token; a URL's tokens fetch the rules indexed under them, and only those run their regular expression.

Two kinds of rules: host/path rules, of which the longest that fits decides, and patterns of the method itself,
which decide where no host/path rule fits. Where nothing matches the URL is allowed.

Scale: built-in functions only. Equal URLs meet before tokens are made; HTML is never read. The index is as small as
the rule set, and Spark broadcasts it only below its threshold; a hot token makes a hot join key otherwise,
which Spark can split, as only partial sums follow.

Edge cases: a null URL or one without ``://`` has an empty host and path, and no rule fits it. Repeated rows give
repeated results; equal rules count once. Extra columns of ``pages`` pass through ``judge``.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm._shared import Scratch, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A rule: its name, a regular expression over host and path, the verdict, and tokens that a match must hold."""

    name: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    explicit: bool = False


def host_path_rule(verdict: str, name: str) -> Rule:
    """For a host with its subdomains and a path prefix, like ``example.org/en/``."""
    host, slash, path = name.partition("/")
    inside = re.findall("[a-z0-9]+", host)
    # the last word of the prefix may go on in the URL, so it is a token only if the prefix goes on after it
    inside += re.findall("[a-z0-9]+(?![A-Za-z0-9]|$)", path) if re.fullmatch("[^A-Z]*", path) else []
    return Rule(name, r"^(?:[^/]*\.)?" + re.escape(host) + re.escape(slash + path), verdict, tuple(inside), True)


#: The method's own patterns: hosts that sell links or goods by keyword, and trackers. A larger list is a parameter of ``judge``.
PATTERNS = (
    Rule("spam farms", r"^(?:[^/]*\.)?spam-farm\.", "block", ("spam", "farm")),
    Rule("pill shops", r"^(?:[^/]*\.)?cheap-pills\.", "block", ("cheap", "pills")),
    Rule("casinos", r"^(?:[^/]*[.-])?casino[.-]", "block", ("casino",)),
    Rule("bets", r"^(?:[^/]*\.)?free-bets\.", "block", ("free", "bets")),
    Rule("adult", r"^(?:[^/]*\.)?adult-[^./]*\.", "block", ("adult",)),
    Rule("trackers", r"^(?:[^/]*\.)?ads-track[^./]*\.", "block", ("ads",)),
)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as a table: name, pattern, verdict, tokens, explicit, size."""
    if bare := [r.name for r in rules if not r.tokens]:
        raise ValueError(f"rules without a literal token can't be indexed: {bare}")
    shape = "name string, pattern string, verdict string, tokens array<string>, explicit int, size int"
    rows = [F.struct(F.lit(r.name).alias("name"), F.lit(r.pattern).alias("pattern"), F.lit(r.verdict).alias("verdict"), F.array(*map(F.lit, r.tokens)).cast("array<string>").alias("tokens"), F.lit(int(r.explicit)).alias("explicit"), F.lit(len(r.name)).alias("size")) for r in dict.fromkeys(rules)]
    if not rows:
        return spark.range(0).select(F.from_json(F.lit("{}"), shape).alias("r")).select("r.*")
    return spark.range(1).select(F.inline(F.array(*rows)))


def verdicts(urls: DataFrame, rules: DataFrame, scratch: Scratch) -> DataFrame:
    """``(url, best)`` for the distinct ``urls(url)`` that some rule of ``rules`` matches."""
    parts = urls.select("url", F.concat(host_of(F.col("url")), path_of(F.col("url"))).alias("target"))
    tokens = parts.select("url", "target", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("target"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("token"))
    literal = rules.select("name", F.explode("tokens").alias("token"))
    known = literal.select(F.col("token").alias("known")).distinct()
    counts = tokens.join(known, F.col("token") == F.col("known"), "left_semi").groupBy("token").agg(F.count("*").alias("n")).withColumnRenamed("token", "counted")
    rarest = literal.join(counts, F.col("token") == F.col("counted"), "left").groupBy("name").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("under"))
    index = scratch.keep(rules.join(rarest.withColumnRenamed("name", "rule_name"), F.col("name") == F.col("rule_name")).select("name", "pattern", "verdict", "explicit", "size", "under"), "index")
    candidates = tokens.join(index, F.col("token") == F.col("under")).where(F.expr("regexp_like(target, pattern)"))
    return candidates.groupBy("url").agg(F.max(F.struct("explicit", "size", "name", "verdict")).alias("best"))


def judge(pages: DataFrame, rules: list[Rule], patterns: tuple[Rule, ...] = PATTERNS, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; input columns of these names are replaced."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    urls = scratch.keep(pages.where("url is not null").select("url").distinct(), "urls")
    url, met = f"url_{uuid.uuid4().hex}", f"best_{uuid.uuid4().hex}"
    best = verdicts(urls, rule_table(spark, [*rules, *patterns]), scratch).select(F.col("url").alias(url), F.col("best").alias(met))
    kept = pages.select(*without(pages, "host", "path", "rule", "verdict"))
    joined = kept.join(best, F.col("url") == F.col(url), "left").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return joined.withColumns({"rule": F.when(F.col(f"{met}.explicit") == 1, F.col(f"{met}.name")), "verdict": F.coalesce(F.col(f"{met}.verdict"), F.lit(default))}).drop(url, met)
