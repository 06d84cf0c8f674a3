"""Verdicts on URLs by pattern rules that are found through their rarest literal token.

A rule is a pattern: text in which `^` stands for one character that is no letter or digit, or for the end, and `*` for
any run of characters. Runs of letters and digits that such characters bound on both sides are its literal tokens: a URL
that fits the rule has each of them as a token. Every rule is filed under the token that the fewest URLs of the table
have; a URL's tokens fetch its candidates, and the regular expressions of only those run on it. DataFrame functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.operators.skew import broadcast_if_small

BROADCAST_RULES = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """`name` is reported if the rule decides; a rule without one only decides where no named rule fits."""

    action: str
    regex: str
    tokens: tuple[str, ...]
    name: str | None
    size: int


def host_rule(action: str, host_and_path: str) -> Rule:
    """Fits the host and its subdomains where the path starts with the rule's: `example.com/en/`."""
    regex = r"(?s)^[^/]*\." + re.escape(host_and_path)
    return Rule(action, regex, _tokens("." + host_and_path), host_and_path, len(host_and_path))


def pattern_rule(action: str, pattern: str) -> Rule:
    parts = {"^": "(?:[^A-Za-z0-9]|$)", "*": ".*"}
    regex = "(?s)" + "".join(parts.get(c) or re.escape(c) for c in pattern)
    return Rule(action, regex, _tokens(pattern), None, len(pattern))


def _tokens(pattern: str) -> tuple[str, ...]:
    """Runs of letters and digits with a bounding character on both sides."""
    found = re.findall(r"(?<=[^A-Za-z0-9*])[A-Za-z0-9]+(?=[^A-Za-z0-9*])", pattern)
    if not found:
        raise ValueError(f"no token of {pattern!r} is bounded on both sides")
    return tuple(dict.fromkeys(found))


_LITERAL = "(?<=[^A-Za-z0-9*])[A-Za-z0-9]+(?=[^A-Za-z0-9*])"
_FILED = "rule_id", "tokens", "action", "regex", "name", "size"


def _listed(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """A list of rules as a table of literals."""
    each = [
        F.struct(*[F.lit(x).alias(n) for n, x in zip(_FILED, (i, list(r.tokens), r.action, r.regex, r.name, r.size), strict=True)])
        for i, r in enumerate(rules)
    ]
    empty = F.expr("cast(array() as array<struct<rule_id:int,tokens:array<string>,action:string,regex:string,name:string,size:int>>)")
    return spark.range(1).select(F.inline(F.array(*each) if each else empty))


def _of_table(rules: DataFrame) -> DataFrame:
    """Rules (`action`, `host`, `pattern`) as `host_rule` and `pattern_rule` make them: a row with a host is a host rule."""
    named = F.col("host").isNotNull()
    text = F.when(named, F.concat(F.lit("."), "host")).otherwise(F.col("pattern"))
    # a host holds no wildcards; in a pattern all but these, letters and digits is escaped
    plain = F.regexp_replace("text", r"([^A-Za-z0-9*^])", r"\\$1")
    wild = F.replace(F.replace(plain, F.lit("^"), F.lit("(?:[^A-Za-z0-9]|$)")), F.lit("*"), F.lit(".*"))
    literal = F.regexp_replace("text", r"([^A-Za-z0-9])", r"\\$1")
    tokens = F.array_distinct(F.regexp_extract_all("text", F.lit(_LITERAL), F.lit(0)))
    problem = F.raise_error(F.concat(F.lit("no token is bounded on both sides: "), F.coalesce("text", F.lit("NULL"))))
    made = rules.select("action", F.col("host").alias("name"), text.alias("text"))
    return made.select(
        F.xxhash64("action", "text", F.col("name").isNull()).alias("rule_id"),
        F.when(F.size(tokens) > 0, tokens).otherwise(problem.cast("array<string>")).alias("tokens"),
        "action",
        F.concat(F.lit("(?s)"), F.when(F.col("name").isNotNull(), F.concat(F.lit("^[^/]*"), literal)).otherwise(wild)).alias("regex"),
        "name",
        (F.char_length("text") - F.col("name").isNotNull().cast("int")).alias("size"),
    )


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(F.col(url), PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), PARTS, 2), F.lit(""))


def judge_urls(
    pages: DataFrame, rules: list[Rule] | DataFrame, keep: list[str], url: str = "url", default: str = "allow"
) -> DataFrame:
    """The `keep` columns of every row with `host`, `path`, `rule` and `verdict`. `rules` is a short list, or a table of any
    size with `action`, `host` (as `example.com/en/`, or NULL) and `pattern` (where there is no host).

    Among the named rules that fit, the longest decides (then the first by name); without one the longest unnamed rule;
    without any, `default`, with a NULL rule. A NULL url, or one without `://`, has an empty host and path. Repeated rows
    and ties stay as they are; an empty table gives an empty one. Each distinct host and path is judged once.
    """
    parsed = pages.select(*keep, host_of(url).alias("host"), path_of(url).alias("path"))
    places = parsed.select("host", "path").distinct()
    spelled = places.withColumn("subject", F.concat(F.lit("."), "host", "path")).withColumn(
        "token", F.explode(F.array_distinct(F.split("subject", "[^A-Za-z0-9]+")))
    )
    known = _of_table(rules).distinct() if isinstance(rules, DataFrame) else _listed(pages.sparkSession, rules)
    filed = _filed(known, spelled)
    candidates = spelled.join(broadcast_if_small(filed, BROADCAST_RULES)[0], "token")
    fitting = candidates.filter(F.expr("subject rlike regex"))
    best = fitting.groupBy("host", "path").agg(
        F.min(F.struct(F.col("name").isNull().alias("unnamed"), (-F.col("size")).alias("size"), "name", "action")).alias("best")
    )
    judged = parsed.join(best, ["host", "path"], "left")
    return judged.select(
        *keep,
        "host",
        "path",
        F.col("best.name").alias("rule"),
        F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"),
    )


def _filed(rules: DataFrame, spelled: DataFrame) -> DataFrame:
    """Each rule under its rarest token."""
    tokens = rules.withColumn("token", F.explode("tokens")).drop("tokens")
    counts = spelled.select("token").join(tokens.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    order = Window.partitionBy("rule_id").orderBy(F.coalesce("count", F.lit(0)), "token")
    ranked = tokens.join(counts, "token", "left").withColumn("at", F.row_number().over(order))
    # a token that no URL has leads nowhere
    return ranked.filter("at = 1 and count is not null").drop("at", "rule_id", "count")
