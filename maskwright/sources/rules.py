"""Ordered host rules, from a list or a JSON file."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.fixed_values import DEFAULT_RULES

RULES_SCHEMA = "ord int, id string, host string, host_contains string, action string"
_RULE = "array<struct<id:string,match:struct<host:string,host_contains:string>,action:string>>"


def load_rules(spark: SparkSession, rules: str | Iterable[Mapping]) -> DataFrame:
    """The rules with their order made explicit; none means that everything is allowed.

    A path names a JSON file `{"rules": [{"id", "match": {"host", "host_contains"}, "action"}]}`.
    """
    if isinstance(rules, str):
        read = spark.read.schema(f"rules {_RULE}").json(rules, multiLine=True)
        table = read.select(F.posexplode("rules").alias("ord", "r")).select(
            "ord",
            F.coalesce("r.id", F.lit("")).alias("id"),
            F.coalesce("r.match.host", F.lit("")).alias("host"),
            F.coalesce("r.match.host_contains", F.lit("")).alias("host_contains"),
            F.coalesce("r.action", F.lit("")).alias("action"),
        )
        return load_rules(spark, []) if table.isEmpty() else table
    listed = list(rules) or DEFAULT_RULES
    rows = [
        (i, r.get("id") or "", r.get("host") or "", r.get("host_contains") or "", r.get("action") or "")
        for i, r in enumerate(listed)
    ]
    return spark.createDataFrame(rows, RULES_SCHEMA)
