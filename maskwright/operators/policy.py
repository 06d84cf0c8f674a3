"""Ordered rules over hosts, and which hosts are inspected."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.fixed_values import DEFAULT_RULES
from maskwright.functions.hosts import normalize_host
from maskwright.functions.labels import trimmed
from maskwright.operators.skew import hot_split_join
from maskwright.session import written

MAX_INLINE = 100
GRAM = 4
ACTIONS = ["block", "allow", "mitm"]


def _decision(action: Column, rule_id: Column) -> Column:
    known = F.lower(action).isin(ACTIONS)
    return F.struct(
        F.when(known, F.lower(action)).otherwise(F.lit("block")).alias("decision"),
        F.when(known, F.lit("matched rule"))
        .otherwise(F.concat(F.lit('invalid action "'), action, F.lit('"')))
        .alias("reason"),
        F.when(rule_id == "", F.lit("unnamed")).otherwise(rule_id).alias("rule_id"),
    )


def _default() -> Column:
    return F.struct(
        F.lit("allow").alias("decision"), F.lit("default allow").alias("reason"), F.lit("default").alias("rule_id")
    )


def _text(rule: Mapping, field: str) -> str:
    return rule.get(field) or ""


def _inline(df: DataFrame, rules: list[Mapping], host: str) -> DataFrame:
    name = F.lower(F.col(host))
    result = _default()
    for rule in reversed(rules):
        exact, part = _text(rule, "host"), _text(rule, "host_contains")
        match = F.lit(not exact and not part)
        if exact:
            match = match | (name == exact.lower())
        if part:
            match = match | F.contains(name, F.lit(part.lower()))
        outcome = _decision(F.lit(_text(rule, "action")), F.lit(_text(rule, "id")))
        result = F.when(match, outcome).otherwise(result)
    return df.withColumn("__decision", result)


def _grams(text: str, sizes: list[int]) -> str:
    """All pieces of a text that are as long as one of the sizes, each once."""
    pieces = [
        f"if(char_length({text}) >= {n}, transform(sequence(1, greatest(1, char_length({text}) - {n - 1})), "
        f"i -> substr({text}, i, {n})), cast(array() as array<string>))"
        for n in sizes
    ]
    return f"explode(array_distinct(concat({', '.join(pieces)})))"


def _containing(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """The first rule for each host (`__name`) of those whose `part` it contains, by an index of the rules.

    Each part is filed under that piece of `GRAM` characters that the fewest hosts have, or under itself if it is
    shorter. A host looks up its own pieces, in proportion to its length, and only what is filed there is compared.
    """
    parts = rules.filter("part <> ''").groupBy("part").agg(F.min(F.struct("ord", "id", "action")).alias("rule"))
    parts = written(parts, "policy-parts")
    # Which lengths below GRAM there are: GRAM - 1 numbers at most.
    short = parts.select(F.char_length("part").alias("n")).filter(F.col("n") < GRAM).distinct().collect()
    sizes = sorted(r["n"] for r in short)
    looked_up = written(hosts.select("__name", F.expr(_grams("__name", [*sizes, GRAM])).alias("gram")), "policy-grams")
    common = looked_up.groupBy("gram").agg(F.count("*").alias("n"))
    own = F.expr(_grams("part", [GRAM]))
    pieces = parts.filter(F.char_length("part") >= GRAM).select("part", own.alias("gram"))
    # A piece that no host has leads nowhere, so its rule may go.
    known = pieces.join(common, "gram", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    filed = known.filter("least.n > 0").select("part", F.col("least.gram").alias("gram"))
    filed = filed.unionByName(parts.filter(F.char_length("part") < GRAM).select("part", F.col("part").alias("gram")))
    filed = written(filed.join(parts, "part"), "policy-filed")
    asked = written(looked_up.join(filed.select("gram").distinct(), "gram", "left_semi"), "policy-asked")
    candidates = hot_split_join(asked, filed, ["gram"], ["__name"], how="inner")
    return candidates.filter(F.contains("__name", "part")).groupBy("__name").agg(F.min("rule").alias("rule"))


def _joined(df: DataFrame, rules: DataFrame, host: str) -> DataFrame:
    """Any number of rules by equi-joins on the distinct hosts: whole names, and parts by way of an index.

    Rows of one host may be alike in everything, so a host with a large part of the rows is left to the skew join
    of adaptive execution, which splits by where rows were written and not by what is in them.
    """
    clean = rules.select(
        "ord",
        F.coalesce("id", F.lit("")).alias("id"),
        F.lower(F.coalesce("host", F.lit(""))).alias("exact"),
        F.lower(F.coalesce("host_contains", F.lit(""))).alias("part"),
        F.coalesce("action", F.lit("")).alias("action"),
    )
    hosts = written(df.select(F.lower(host).alias("__name")).distinct(), "policy-hosts")
    rule = F.struct("ord", "id", "action")
    exact = clean.filter("exact <> ''").groupBy(F.col("exact").alias("__name")).agg(F.min(rule).alias("rule"))
    found = hosts.join(exact, "__name").unionByName(_containing(hosts, clean))
    every = clean.filter("exact = '' and part = ''").orderBy("ord").limit(1).collect()
    best = F.min("rule").alias("rule")
    chosen = hosts.join(found.groupBy("__name").agg(best), "__name", "left")
    for first in every:
        whole = F.struct(*[F.lit(first[c]).alias(c) for c in ("ord", "id", "action")])
        whole = whole.cast(found.schema["rule"].dataType)
        chosen = chosen.withColumn("rule", F.least(F.coalesce("rule", whole), whole))
    decision = _decision(F.col("rule.action"), F.col("rule.id"))
    outcome = chosen.select("__name", F.when(F.col("rule").isNull(), _default()).otherwise(decision).alias("__decision"))
    named = df.withColumn("__host", F.lower(host))
    return named.join(outcome, F.col("__host").eqNullSafe(F.col("__name")), "left").drop("__host", "__name")


def evaluate_policy(df: DataFrame, rules: Iterable[Mapping] | DataFrame, host: str = "host") -> DataFrame:
    """Add `decision`, `reason` and `rule_id` of the first rule, in order, that matches the host.

    A rule matches by whole name or by part, case-blind, and every host if it names neither. Few rules become
    one CASE expression; more than that, or a large rules table, become equi-joins, which write tables between steps
    to the shared folder when called. A NULL host matches the rules that name nothing.
    """
    if isinstance(rules, DataFrame):
        few = rules.orderBy("ord").limit(MAX_INLINE + 1).collect()
        if len(few) <= MAX_INLINE:
            decided = _inline(df, [r.asDict() for r in few] or DEFAULT_RULES, host)
        else:
            decided = _joined(df, rules, host)
    else:
        rules = list(rules) or DEFAULT_RULES
        if len(rules) <= MAX_INLINE:
            decided = _inline(df, rules, host)
        else:
            rows = [
                (i, _text(r, "id"), _text(r, "host"), _text(r, "host_contains"), _text(r, "action"))
                for i, r in enumerate(rules)
            ]
            schema = "ord int, id string, host string, host_contains string, action string"
            decided = _joined(df, df.sparkSession.createDataFrame(rows, schema), host)
    return decided.select(*df.columns, "__decision.*")


def intercept_scope(
    df: DataFrame,
    domains: Iterable[str] | DataFrame,
    host: str = "host",
    decision: str = "decision",
    enabled: bool = True,
    into: str = "inspect",
) -> DataFrame:
    """Add whether the traffic of a host is inspected: decided so, and the host is in or below a listed domain.

    An empty list means every host. A table of domains is joined by equality on the ends of the host name.
    """
    wanted = F.coalesce(F.col(decision) == "mitm", F.lit(False)) & F.lit(enabled)
    name = F.lower(normalize_host(F.col(host)))
    if not isinstance(domains, DataFrame):
        listed = list(domains)
        if len(listed) <= MAX_INLINE:
            inside = F.lit(not listed)
            for domain in listed:
                d = domain.strip().lower()
                inside = inside | (name == d) | name.endswith("." + d)
            return df.withColumn(into, wanted & F.coalesce(inside, F.lit(False)))
        domains = df.sparkSession.createDataFrame([(d,) for d in listed], "domain string")
    clean = domains.select(F.lower(trimmed(F.col("domain"))).alias("__end")).distinct()
    if clean.isEmpty():
        return df.withColumn(into, wanted)
    ends = F.expr(
        "transform(sequence(1, size(split(__name, '[.]', -1))), "
        "i -> array_join(slice(split(__name, '[.]', -1), i, 1000000), '.'))"
    )
    hosts = df.select(name.alias("__name")).distinct()
    listed_hosts = (
        hosts.select("__name", F.explode(ends).alias("__end"))
        .join(clean, "__end", "left_semi")
        .select("__name", F.lit(True).alias("__inside"))
        .distinct()
    )
    return (
        df.withColumn("__name", name)
        .join(listed_hosts, "__name", "left")
        .withColumn(into, wanted & F.coalesce("__inside", F.lit(False)))
        .drop("__name", "__inside")
    )
