"""Statistics over audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.fixed_values import RECENT_COLUMNS, RECENT_REQUESTS, TOP_DOMAINS
from maskwright.functions.labels import masked_counts, trimmed
from maskwright.functions.numbers import share_steps

MINUTES = 5


def _types(items: str = "sanitized_items") -> Column:
    return F.coalesce(F.col(items)["type"], F.array().cast("array<string>"))


def masked_types(audit: DataFrame) -> DataFrame:
    """One row per masked item, by upper-case type."""
    long = audit.select(F.explode(_types()).alias("type"))
    return long.select(F.upper(trimmed(F.col("type"))).alias("type")).filter(F.col("type") != "")


def totals(audit: DataFrame) -> DataFrame:
    """Requests and masked items in all."""
    named = F.filter(_types(), lambda t: trimmed(t) != "")
    return audit.agg(
        F.count("*").alias("requests"), F.coalesce(F.sum(F.size(named)), F.lit(0)).alias("masked_items")
    )


def by_type(audit: DataFrame) -> DataFrame:
    return masked_types(audit).groupBy("type").agg(F.count("*").alias("n"))


def type_share(audit: DataFrame) -> DataFrame:
    """Items by type with their share of all items and the length of a bar of twenty steps."""
    counts = by_type(audit)
    total = totals(audit).select("masked_items").scalar()
    with_total = counts.withColumn("total", total)
    return with_total.select(
        "type",
        "n",
        (F.col("n") / F.col("total")).alias("share"),
        F.expr(share_steps("n", "total")).alias("steps"),
    )


def _mean_positive(name: str) -> Column:
    """Mean of the values above zero: a zero stands for a missing measurement."""
    return F.coalesce(F.avg(F.when(F.col(name) > 0, F.col(name))), F.lit(0.0))


def latency(audit: DataFrame) -> DataFrame:
    return audit.agg(
        _mean_positive("sanitize_latency_ms").alias("sanitize_ms"),
        _mean_positive("upstream_latency_ms").alias("upstream_ms"),
        _mean_positive("total_latency_ms").alias("total_ms"),
    )


def event_time(timestamp: Column) -> Column:
    """RFC 3339 text as a timestamp; NULL if it is not one."""
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
    return F.when(timestamp.rlike(shape), F.try_to_timestamp(timestamp))


def _minute_slot(now: Column) -> Column:
    """0 for the oldest of the last five minutes up to 4 for the newest; NULL outside."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(event_time(F.col("timestamp")))
    inside = (age >= 0) & (age < MINUTES * 60_000_000)
    return F.when(inside, F.lit(MINUTES - 1) - F.floor(age / 60_000_000)).cast("int")


def _last_minutes(slot: str) -> Column:
    """Counts of the last five minutes, oldest first, as one aggregate."""
    return F.array(*[F.count(F.when(F.col(slot) == i, F.lit(1))) for i in range(MINUTES)])


def last_five_minutes(audit: DataFrame, now: Column) -> DataFrame:
    """Requests in each of the last five minutes before `now`, oldest first."""
    slots = audit.select(_minute_slot(now).alias("slot"))
    return slots.agg(_last_minutes("slot").alias("counts")).select(F.posexplode("counts").alias("minute", "n"))


def per_minute(audit: DataFrame, now: Column) -> DataFrame:
    recent = F.count(_minute_slot(now))
    return audit.agg((recent / F.lit(float(MINUTES))).alias("per_minute"))


def top_domains(audit: DataFrame, n: int = TOP_DOMAINS) -> DataFrame:
    host = trimmed(F.col("host"))
    counts = audit.select(host.alias("domain")).filter(F.col("domain") != "").groupBy("domain")
    return counts.agg(F.count("*").alias("requests")).orderBy(F.desc("requests"), "domain").limit(n)


def masked_per_request(audit: DataFrame) -> DataFrame:
    """Add the counts by type of each request, and how many items it has, blank ones included."""
    return audit.withColumns(
        {"masked_by": masked_counts(_types()), "masked_count": F.size(_types()).cast("bigint")}
    )


def recent(audit: DataFrame, order: list[str], n: int = RECENT_REQUESTS) -> DataFrame:
    """The last requests in log order, newest first. `order` names the columns of the log order."""
    last = audit.orderBy(*[F.desc(c) for c in order]).limit(n)
    return masked_per_request(last).select(
        *[F.col(c).alias(f"log_{c}") for c in order],
        "timestamp",
        trimmed(F.col("host")).alias("domain"),
        "method",
        "status_code",
        "masked_by",
        "masked_count",
        F.col("sanitize_latency_ms").alias("sanitize_ms"),
        F.col("upstream_latency_ms").alias("upstream_ms"),
        F.col("total_latency_ms").alias("total_ms"),
    )


def recent_report(audit: DataFrame, order: list[str], n: int = RECENT_REQUESTS) -> DataFrame:
    """The recent requests as the text columns of the CSV report."""
    rows = recent(audit, order, n)
    values = [
        F.col("timestamp"),
        F.col("domain"),
        F.col("method"),
        F.coalesce("status_code", F.lit(0)).cast("string"),
        F.array_join(F.array_sort(F.map_keys("masked_by")), "|"),
        F.col("masked_count").cast("string"),
        # By the exact binary value, as printf does; format_string rounds the shortest decimal instead.
        F.expr("format_number(coalesce(total_ms, 0d), '0.000')"),
    ]
    return rows.orderBy(*[F.desc(f"log_{c}") for c in order]).select(
        *[v.alias(name) for v, name in zip(values, RECENT_COLUMNS, strict=True)]
    )


def snapshot(
    audit: DataFrame,
    now: Column,
    order: list[str],
    status: str = "stopped",
    uptime_seconds: int = 0,
    port: int = 0,
    top_n: int = TOP_DOMAINS,
    recent_n: int = RECENT_REQUESTS,
) -> DataFrame:
    """All statistics as one nested row.

    One aggregate reads the log for everything that needs no grouping; types, domains and the newest requests are
    small results of their own and are brought in as scalar subqueries.
    """
    base = audit.withColumn("__slot", _minute_slot(now)).agg(
        F.count("*").alias("total"),
        _last_minutes("__slot").alias("last_5_minute"),
        F.coalesce(F.sum(F.size(F.filter(_types(), lambda t: trimmed(t) != ""))), F.lit(0)).alias("masked"),
        _mean_positive("sanitize_latency_ms").alias("sanitize_ms"),
        _mean_positive("upstream_latency_ms").alias("upstream_ms"),
        _mean_positive("total_latency_ms").alias("total_ms"),
    )
    latest = recent(audit, order, recent_n)
    return snapshot_row(base, by_type(audit), top_domains(audit, top_n), latest, order, status, uptime_seconds, port)


def snapshot_row(
    base: DataFrame,
    types: DataFrame,
    domains: DataFrame,
    latest: DataFrame,
    order: list[str],
    status: str = "stopped",
    uptime_seconds: int = 0,
    port: int = 0,
) -> DataFrame:
    """The nested row of a snapshot from its parts: one row of figures, items by type, the top domains, the newest requests."""
    types = types.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"))
    domains = domains.agg(F.collect_list(F.struct("requests", "domain")).alias("rows"))
    sorted_domains = F.expr(
        "transform(array_sort(rows, (a, b) -> case when a.requests > b.requests then -1 when "
        "a.requests < b.requests then 1 when a.domain < b.domain then -1 when a.domain > b.domain then 1 else 0 end), "
        "r -> named_struct('domain', r.domain, 'requests', r.requests))"
    )
    logged = [f"log_{c}" for c in order]
    fields = [c for c in latest.columns if c not in logged]
    newest = latest.agg(
        F.collect_list(F.struct(F.struct(*logged).alias("place"), F.struct(*fields).alias("row"))).alias("rows")
    )
    newest_first = F.expr(
        "transform(array_sort(rows, (a, b) -> case when a.place > b.place then -1 when a.place < b.place then 1 "
        "else 0 end), r -> r.row)"
    )
    rate = F.aggregate("last_5_minute", F.lit(0).cast("bigint"), lambda a, x: a + x) / F.lit(float(MINUTES))
    no_types = F.create_map().cast("map<string,bigint>")
    return base.select(
        F.lit(status or "stopped").alias("status"),
        F.lit(uptime_seconds).cast("bigint").alias("uptime_seconds"),
        F.lit(port).alias("port"),
        F.struct("total", rate.alias("per_minute"), "last_5_minute").alias("requests"),
        F.struct(
            F.col("masked").alias("total"), F.coalesce(types.scalar(), no_types).alias("by_type")
        ).alias("masked_items"),
        F.struct("sanitize_ms", "upstream_ms", "total_ms").alias("latency"),
        domains.select(sorted_domains).scalar().alias("top_domains"),
        newest.select(newest_first).scalar().alias("recent"),
    )


def stats_json(snapshot_row: DataFrame) -> DataFrame:
    """The statistics as JSON text."""
    return snapshot_row.select(F.to_json(F.struct(*snapshot_row.columns)).alias("value"))
