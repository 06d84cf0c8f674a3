"""Statistics that are kept up to date over a stream of audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.labels import trimmed
from maskwright.operators.stats import event_time

REFRESH = "2 seconds"
LATENESS = "10 minutes"


def _timed(audit: DataFrame, lateness: str | None) -> DataFrame:
    timed = audit.withColumn("event_time", event_time(F.col("timestamp"))).filter("event_time is not null")
    return timed if lateness is None else timed.withWatermark("event_time", lateness)


def watch_stats(audit: DataFrame, lateness: str | None = LATENESS) -> DataFrame:
    """Requests, masked items and latency per minute, from a stream of audit events.

    Write it in update mode, with a trigger of two seconds, to see each minute grow; events that are later than
    the watermark allows no longer count. Without lateness (None) every event counts and the state keeps every minute:
    for runs over a finite log, whose files may come in any order.
    """
    named = F.filter("sanitized_items", lambda i: trimmed(i["type"]) != "")
    items = F.coalesce(F.size(named), F.lit(0))
    return (
        _timed(audit, lateness)
        .groupBy(F.window("event_time", "1 minute").alias("window"))
        .agg(
            F.count("*").alias("requests"),
            F.sum(F.greatest(items, F.lit(0))).alias("masked_items"),
            F.sum(F.when(F.col("total_latency_ms") > 0, F.col("total_latency_ms"))).alias("latency_sum"),
            F.count(F.when(F.col("total_latency_ms") > 0, F.lit(1))).alias("latency_n"),
        )
        .select(
            F.col("window.start").alias("minute"),
            "requests",
            "masked_items",
            F.coalesce(F.col("latency_sum") / F.nullif("latency_n", F.lit(0)), F.lit(0.0)).alias("total_ms"),
        )
    )


def watch_counts(audit: DataFrame, lateness: str | None = LATENESS) -> DataFrame:
    """Requests by host and masked items by type per minute: minute, what (`host` or `type`), name, n.

    One aggregate for both, keyed by the minute as well, so a host or type with most of the events is summed up before
    the shuffle. Blank hosts and types don't count. `lateness` is as in `watch_stats`.
    """
    def pair(what: str, name: Column) -> Column:
        return F.struct(F.lit(what).alias("what"), name.alias("name"))

    types = F.coalesce(F.col("sanitized_items")["type"], F.array().cast("array<string>"))
    pairs = F.concat(
        F.array(pair("host", trimmed(F.col("host")))), F.transform(types, lambda t: pair("type", F.upper(trimmed(t))))
    )
    return (
        _timed(audit, lateness)
        .select("event_time", F.explode(pairs).alias("p"))
        .filter("p.name <> ''")
        .groupBy(F.window("event_time", "1 minute").alias("window"), "p.what", "p.name")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("minute"), "what", "name", "n")
    )
