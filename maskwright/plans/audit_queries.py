"""Queries over the audit log and request traces."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.labels import masked_label, unique_types
from maskwright.operators import sketches, stats, traffic
from maskwright.plans import tables
from maskwright.session import scratch_dir, written
from maskwright.sources.appended import store_of
from maskwright.sources.audit import audit_tail, follow_appended, follow_audit, parse_audit, read_audit, write_audit
from maskwright.streaming.snapshot import watch_snapshot
from maskwright.streaming.stats import watch_counts, watch_stats

LOG_ORDER = ["timestamp", "event_id"]
_ROW = [
    "timestamp",
    "host",
    "status_code",
    "decision",
    "reason",
    "total_latency_ms",
    "sanitized",
    "masked_types",
]


def _written(spark: SparkSession, folder: str, name: str) -> str:
    """The audit log written as JSON lines, with lines among them that do not parse."""
    path = scratch_dir(spark, name)
    log = tables.audit(spark, folder)
    write_audit(log, path, stamp=False)
    torn = log.filter("event_id % 50 = 0").select(F.concat(F.lit('{"timestamp": "'), "timestamp").alias("value"))
    torn.write.mode("append").text(path)
    return path


def _rows(audit: DataFrame) -> DataFrame:
    types = F.concat_ws(",", F.col("sanitized_items")["type"])
    filled = audit.withColumns(
        {
            "masked_types": types,
            "total_latency_ms": F.round(F.coalesce("total_latency_ms", F.lit(0.0)), 6),
            "sanitized": F.coalesce("sanitized", F.lit(False)),
        }
    )
    return filled.select(*_ROW)


_ROWS_SQL = (
    f'SELECT "timestamp", host, status_code, decision, reason, round(total_latency_ms, 6) AS total_latency_ms, '
    f"len(types) > 0 AS sanitized, array_to_string(types, ',') AS masked_types FROM ({tables.AUDIT_SQL})"
)


def audit_read(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(read_audit(spark, _written(spark, folder, "audit-read")))


def audit_write(spark: SparkSession, folder: str) -> DataFrame:
    """How often each field was written: empty ones are left out, the leading ones never."""
    path = scratch_dir(spark, "audit-write")
    write_audit(tables.audit(spark, folder), path)
    keys = F.json_object_keys("value")
    return spark.read.text(path).select(F.explode(keys).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def audit_follow(spark: SparkSession, folder: str) -> DataFrame:
    source = _written(spark, folder, "audit-follow")
    output, checkpoint = scratch_dir(spark, "audit-followed"), scratch_dir(spark, "checkpoint")
    query = (
        follow_audit(spark, source)
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return _rows(spark.read.parquet(output))


FILES, ROUNDS = 8, 3
FILE_BYTES = 64 << 20


def _log_files(lines: DataFrame) -> int:
    """How many files the log has: `FILES`, or more of about `FILE_BYTES` each, as one task writes a whole file."""
    size = lines.agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0
    return max(FILES, -(-size // FILE_BYTES))


def _grown(lines: DataFrame, log: str, upto: int, files: int) -> None:
    """The log's files as they are once the lines of the rounds before `upto` have come; half a line stands behind them.

    A file is made anew under another name and moved into place, so a task that is repeated does no harm.
    """

    def write(rows: Iterator[Row]) -> None:
        store, folder = store_of(log)
        store.create_dir(folder)
        for number, own in groupby(rows, key=lambda r: r["file"]):
            made, left = f"{folder}/_{number}-{uuid.uuid4().hex}", b""
            with store.open_output_stream(made) as out:
                for row in own:
                    line = row["value"].encode() + b"\n"
                    if row["round"] < upto:
                        out.write(line)
                    else:
                        left = left or line[: len(line) // 2]
                out.write(left)
            store.move(made, f"{folder}/audit-{number}.log")

    # each file is a partition of its own: a hash would put some of them together
    lines.repartitionById(files, F.col("file").cast("int")).sortWithinPartitions("file", "round", "value").foreachPartition(write)


def follow_growing(spark: SparkSession, folder: str) -> DataFrame:
    """A log whose files grow between the runs of a stream, which goes on from its checkpoint each time."""
    lines = spark.read.text(_written(spark, folder, "audit-grows"))
    mixed, files = F.xxhash64("value"), _log_files(lines)
    lines = lines.withColumns({"file": F.pmod(mixed, F.lit(files)), "round": F.pmod(F.shiftright(mixed, 16), F.lit(ROUNDS))})
    log, output, checkpoint = (scratch_dir(spark, name) for name in ("growing-log", "audit-followed", "checkpoint"))
    for upto in range(1, ROUNDS + 1):
        _grown(lines, log, upto, files)
        query = (
            follow_appended(spark, log)
            .writeStream.format("parquet")
            .option("path", output)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return _rows(spark.read.parquet(output))


def tail_of_log(spark: SparkSession, folder: str) -> DataFrame:
    return audit_tail(_rows(read_audit(spark, _written(spark, folder, "audit-tail"))), _ROW)


def _watched(spark: SparkSession, folder: str, watch: Callable[[DataFrame, str | None], DataFrame], keys: list[str]) -> DataFrame:
    """The last state of every key of a watched log. The log is finite, so nothing in it counts as late."""
    source = _written(spark, folder, "audit-watch")
    output, checkpoint = scratch_dir(spark, "watched"), scratch_dir(spark, "checkpoint")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    query = (
        watch(follow_audit(spark, source), None)
        .writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    states = spark.read.parquet(output)
    values = [c for c in states.columns if c not in [*keys, "batch_id"]]
    last = states.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("s"))
    utc = F.date_format(F.to_utc_timestamp("minute", F.current_timezone()), "yyyy-MM-dd HH:mm")
    return last.select(utc.alias("minute"), *[k for k in keys if k != "minute"], *[f"s.{v}" for v in values])


def watched_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The per-minute statistics of the followed log."""
    return _watched(spark, folder, watch_stats, ["minute"]).withColumn("total_ms", F.round("total_ms", 6))


def watched_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts and types per minute of the followed log."""
    return _watched(spark, folder, watch_counts, ["minute", "what", "name"])


def _now(audit: DataFrame):
    return audit.agg(F.max(stats.event_time(F.col("timestamp")))).scalar()


def stats_totals(spark: SparkSession, folder: str) -> DataFrame:
    return stats.totals(tables.audit(spark, folder))


def stats_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return stats.by_type(tables.audit(spark, folder))


def stats_latency(spark: SparkSession, folder: str) -> DataFrame:
    means = stats.latency(tables.audit(spark, folder))
    return means.select(*[F.round(c, 6).alias(c) for c in means.columns])


def stats_last5(spark: SparkSession, folder: str) -> DataFrame:
    log = tables.audit(spark, folder)
    return stats.last_five_minutes(log, _now(log)).select(F.col("minute").cast("bigint").alias("minute"), "n")


def stats_rate(spark: SparkSession, folder: str) -> DataFrame:
    log = tables.audit(spark, folder)
    return stats.per_minute(log, _now(log))


def stats_top_domains(spark: SparkSession, folder: str) -> DataFrame:
    return stats.top_domains(tables.audit(spark, folder))


def masked_per_request(spark: SparkSession, folder: str) -> DataFrame:
    rows = stats.masked_per_request(tables.audit(spark, folder))
    count = lambda t: F.coalesce(F.try_element_at("masked_by", F.lit(t)), F.lit(0))
    return rows.select(
        "event_id",
        count("EMAIL").cast("bigint").alias("email"),
        count("PHONE").cast("bigint").alias("phone"),
        F.size("masked_by").cast("bigint").alias("n_types"),
        "masked_count",
    )


def masked_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = stats.masked_per_request(tables.audit(spark, folder))
    return rows.select("event_id", masked_label(F.col("masked_by")).alias("label"))


def unique_type_lists(spark: SparkSession, folder: str) -> DataFrame:
    types = F.col("sanitized_items")["type"]
    twice = F.concat(types, F.array(F.lit(" email ")), types)
    return tables.audit(spark, folder).select(
        "event_id", F.array_join(unique_types(twice), ",").alias("types")
    )


def stats_recent(spark: SparkSession, folder: str) -> DataFrame:
    rows = stats.recent(tables.audit(spark, folder), LOG_ORDER)
    return rows.select(
        F.col("log_event_id").alias("event_id"),
        "timestamp",
        "domain",
        "method",
        "status_code",
        masked_label(F.col("masked_by")).alias("masked"),
        "masked_count",
        F.round("total_ms", 6).alias("total_ms"),
    )


def recent_export(spark: SparkSession, folder: str) -> DataFrame:
    return stats.recent_report(tables.audit(spark, folder), LOG_ORDER)


def type_share(spark: SparkSession, folder: str) -> DataFrame:
    rows = stats.type_share(tables.audit(spark, folder))
    return rows.select("type", "n", F.round("share", 9).alias("share"), "steps")


def _snapshot(spark: SparkSession, folder: str) -> DataFrame:
    log = tables.audit(spark, folder)
    return stats.snapshot(log, _now(log), LOG_ORDER)


def stats_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshot with its nested parts laid out as columns."""
    return _laid_out(_snapshot(spark, folder))


def live_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The last of the snapshots that a stream makes of the log, a few files at a time."""
    source = _written(spark, folder, "audit-live")
    output, state, checkpoint = (scratch_dir(spark, name) for name in ("live", "live-state", "checkpoint"))
    events = parse_audit(spark.readStream.option("maxFilesPerTrigger", 6).text(source))
    watch_snapshot(events, output, state, checkpoint, trigger={"availableNow": True}, status="stopped").awaitTermination()
    made = spark.read.parquet(output)
    return _laid_out(made.filter(F.col("batch_id") == made.agg(F.max("batch_id")).scalar()))


def _laid_out(snapshot: DataFrame) -> DataFrame:
    return snapshot.select(
        "status",
        F.col("requests.total").alias("requests"),
        F.round("requests.per_minute", 6).alias("per_minute"),
        F.concat_ws(",", F.col("requests.last_5_minute").cast("array<string>")).alias("last_5_minute"),
        F.col("masked_items.total").alias("masked_items"),
        masked_label(F.col("masked_items.by_type")).alias("by_type"),
        F.round("latency.sanitize_ms", 6).alias("sanitize_ms"),
        F.round("latency.total_ms", 6).alias("total_ms"),
        F.concat_ws(",", F.col("top_domains")["domain"]).alias("domains"),
        F.concat_ws(",", F.col("recent")["timestamp"]).alias("recent"),
    )


def stats_json(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshot written as a JSON file; read back for its figures."""
    path = scratch_dir(spark, "stats")
    stats.stats_json(_snapshot(spark, folder)).write.text(path)
    value = lambda p: F.get_json_object("value", p)
    return spark.read.text(path).select(
        value("$.status").alias("status"),
        value("$.requests.total").cast("bigint").alias("requests"),
        value("$.masked_items.by_type.EMAIL").cast("bigint").alias("email"),
        F.round(value("$.latency.upstream_ms").cast("double"), 6).alias("upstream_ms"),
        value("$.top_domains[0].domain").alias("first_domain"),
        value("$.recent[0].timestamp").alias("newest"),
    )


PROBABILITIES = [0.5, 0.95, 0.99]


def _sketched(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The log, and its sketches by minute, written and merged first by hour and then into one row."""
    log = tables.audit(spark, folder)
    minutes = written(sketches.minute_sketches(log), "minute-sketches")
    hours = sketches.merge_sketches(minutes.withColumn("hour", F.date_trunc("hour", "minute")), ["hour"])
    return log, sketches.merge_sketches(written(hours, "hour-sketches"))


def latency_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Of each latency the quantiles of merged sketches: how many values, and whether the rank lies in the stated bounds.

    The exact rank of an answer is the share of the log's values below it, or up to it.
    """
    log, merged = _sketched(spark, folder)
    found = F.broadcast(sketches.quantiles(merged, PROBABILITIES))
    columns = F.array(*[F.struct(F.lit(n).alias("what"), F.col(c).alias("v")) for n, c in sketches.LATENCIES.items()])
    values = log.select(F.explode(columns).alias("x")).select("x.*").filter("v > 0")
    ranks = values.join(found, "what").groupBy("what", "p", "n").agg(
        F.avg((F.col("v") < F.col("value")).cast("int")).alias("below"), F.avg((F.col("v") <= F.col("value")).cast("int")).alias("upto")
    )
    error = sketches.rank_error()
    within = (F.col("below") <= F.col("p") + error) & (F.col("upto") >= F.col("p") - error)
    return ranks.select("what", "p", "n", within.alias("within"))


def frequent_hosts(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.frequent_hosts(_sketched(spark, folder)[1], 5)


def trace_durations(spark: SparkSession, folder: str) -> DataFrame:
    timed = traffic.trace_durations(tables.traces(spark, folder))
    return timed.select("id", *[c for c in timed.columns if c.endswith("_us")])


def trace_sample(spark: SparkSession, folder: str) -> DataFrame:
    return traffic.sample_traces(tables.traces(spark, folder)).select("id")


_TYPES = f"SELECT upper(trim(t)) AS type FROM (SELECT unnest(types) AS t FROM ({tables.AUDIT_SQL})) WHERE trim(t) <> ''"
_AVG = "round(coalesce(avg(CASE WHEN {0} > 0 THEN {0} END), 0), 6) AS {1}".format
_AGES = (
    f"SELECT 4 - floor(date_diff('microsecond', ts, (SELECT max(ts) FROM events)) / 60000000.0) AS minute "
    f"FROM ({tables.AUDIT_SQL}) WHERE date_diff('microsecond', ts, (SELECT max(ts) FROM events)) < 300000000"
)
_LAST5 = (
    "SELECT CAST(i AS BIGINT) AS minute, count(a.minute) AS n FROM range(5) t(i) "
    f"LEFT JOIN ({_AGES}) a ON a.minute = i GROUP BY i"
)
_TOP = (
    f"SELECT host AS domain, count(*) AS requests FROM ({tables.AUDIT_SQL}) GROUP BY host "
    "ORDER BY requests DESC, domain LIMIT 5"
)
_LABEL = (
    "CASE len(types) WHEN 0 THEN '-' WHEN 1 THEN CASE types[1] WHEN ' ' THEN '-' ELSE '1 EMAIL' END "
    "ELSE '1 EMAIL, 1 PHONE' END"
)
_RECENT = f'SELECT * FROM ({tables.AUDIT_SQL}) ORDER BY "timestamp" DESC, event_id DESC LIMIT 20'
_ALWAYS = ["timestamp", "method", "host", "path", "status_code", "decision", "reason"]

QUERIES = {
    "audit_read": audit_read,
    "audit_write": audit_write,
    "audit_follow": audit_follow,
    "audit_follow_appended": follow_growing,
    "audit_tail": tail_of_log,
    "watch_stats": watched_stats,
    "watch_counts": watched_counts,
    "stats_totals": stats_totals,
    "stats_by_type": stats_by_type,
    "stats_latency": stats_latency,
    "stats_last5": stats_last5,
    "stats_rate": stats_rate,
    "stats_top_domains": stats_top_domains,
    "masked_per_request": masked_per_request,
    "masked_label": masked_labels,
    "unique_types": unique_type_lists,
    "stats_recent": stats_recent,
    "recent_export": recent_export,
    "type_share": type_share,
    "stats_snapshot": stats_snapshot,
    "live_snapshot": live_snapshot,
    "stats_json": stats_json,
    "latency_quantiles": latency_quantiles,
    "frequent_hosts": frequent_hosts,
    "trace_durations": trace_durations,
    "trace_sample": trace_sample,
}


def _between(start: str, end: str) -> str:
    return f"greatest(coalesce(date_diff('microsecond', {start}, {end}), 0), 0)"


ORACLES = {
    "audit_read": _ROWS_SQL,
    "audit_write": " UNION ALL ".join(
        [f"SELECT '{name}' AS field, count(*) AS n FROM events" for name in _ALWAYS]
        + [
            f"SELECT '{name}' AS field, count(*) FILTER ({name} <> 0) AS n FROM ({tables.AUDIT_SQL})"
            for name in ("sanitize_latency_ms", "upstream_latency_ms", "total_latency_ms")
        ]
        + [
            f"SELECT '{name}' AS field, count(*) FILTER (len(types) > 0) AS n FROM ({tables.AUDIT_SQL})"
            for name in ("sanitized", "sanitized_items")
        ]
    ),
    "audit_follow": _ROWS_SQL,
    "audit_follow_appended": _ROWS_SQL,
    "watch_stats": "SELECT strftime(ts, '%Y-%m-%d %H:%M') AS minute, count(*) AS requests, "
    "CAST(sum(len(list_filter(types, lambda x: trim(x) <> ''))) AS BIGINT) AS masked_items, "
    "round(coalesce(avg(CASE WHEN total_latency_ms > 0 THEN total_latency_ms END), 0), 6) AS total_ms "
    f"FROM ({tables.AUDIT_SQL}) GROUP BY 1",
    "audit_tail": f"SELECT * FROM ({_ROWS_SQL}) ORDER BY {', '.join(f'"{c}" DESC' for c in _ROW)} LIMIT 20",
    "watch_counts": "SELECT strftime(ts, '%Y-%m-%d %H:%M') AS minute, what, name, count(*) AS n FROM ("
    f"SELECT ts, 'host' AS what, trim(host) AS name FROM ({tables.AUDIT_SQL}) UNION ALL "
    f"SELECT ts, 'type' AS what, upper(trim(unnest(types))) AS name FROM ({tables.AUDIT_SQL})) WHERE name <> '' GROUP BY ALL",
    "trace_sample": "SELECT id FROM (SELECT event_id AS id FROM events) "
    "WHERE CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8) AS BIGINT) % 1000000 < 100000",
    "stats_totals": f"SELECT count(*) AS requests, (SELECT count(*) FROM ({_TYPES})) AS masked_items FROM events",
    "stats_by_type": f"SELECT type, count(*) AS n FROM ({_TYPES}) GROUP BY type",
    "stats_latency": "SELECT "
    + ", ".join(_AVG(f"{n}_latency_ms", f"{n}_ms") for n in ("sanitize", "upstream", "total"))
    + f" FROM ({tables.AUDIT_SQL})",
    "latency_quantiles": " UNION ALL ".join(
        f"SELECT '{n}' AS what, unnest({PROBABILITIES})::DOUBLE AS p, count(*) AS n, true AS within FROM ({tables.AUDIT_SQL}) WHERE {c} > 0"
        for n, c in sketches.LATENCIES.items()
    ),
    "frequent_hosts": f"SELECT trim(host) AS host, count(*) AS n FROM ({tables.AUDIT_SQL}) WHERE trim(host) <> '' "
    "GROUP BY 1 ORDER BY n DESC, host LIMIT 5",
    "stats_last5": _LAST5,
    "stats_rate": f"SELECT sum(n) / 5.0::DOUBLE AS per_minute FROM ({_LAST5})",
    "stats_top_domains": _TOP,
    "masked_per_request": "SELECT event_id, CAST(len(list_filter(types, lambda t: t = 'email')) AS BIGINT) AS email, "
    "CAST(len(list_filter(types, lambda t: trim(t) = 'phone')) AS BIGINT) AS phone, "
    "CAST(len(list_filter(types, lambda t: trim(t) <> '')) AS BIGINT) AS n_types, "
    f"CAST(len(types) AS BIGINT) AS masked_count FROM ({tables.AUDIT_SQL})",
    "masked_label": f"SELECT event_id, {_LABEL} AS label FROM ({tables.AUDIT_SQL})",
    "unique_types": "SELECT event_id, CASE WHEN len(types) = 2 THEN 'email,phone' ELSE 'email' END AS types "
    f"FROM ({tables.AUDIT_SQL})",
    "stats_recent": f'SELECT event_id, "timestamp", host AS domain, method, status_code, {_LABEL} AS masked, '
    f"CAST(len(types) AS BIGINT) AS masked_count, round(total_latency_ms, 6) AS total_ms FROM ({_RECENT})",
    "recent_export": f'SELECT "timestamp", host AS domain, method, CAST(status_code AS VARCHAR) AS status, '
    "array_to_string(list_sort(list_filter(list_transform(types, lambda t: upper(trim(t))), lambda t: t <> '')), '|') "
    "AS masked_types, CAST(len(types) AS VARCHAR) AS masked_count, printf('%.3f', total_latency_ms) AS latency_ms "
    f"FROM ({_RECENT})",
    "type_share": "SELECT type, n, round(n / total, 9) AS share, "
    "CAST(least(floor(n / total * 20), 20) AS BIGINT) AS steps FROM ("
    f"SELECT type, count(*) AS n, CAST(sum(count(*)) OVER () AS DOUBLE) AS total FROM ({_TYPES}) GROUP BY type)",
    "stats_snapshot": "SELECT 'stopped' AS status, count(*) AS requests, "
    f"(SELECT round(sum(n) / 5.0::DOUBLE, 6) FROM ({_LAST5})) AS per_minute, "
    f"(SELECT string_agg(CAST(n AS VARCHAR), ',' ORDER BY minute) FROM ({_LAST5})) AS last_5_minute, "
    f"(SELECT count(*) FROM ({_TYPES})) AS masked_items, "
    f"(SELECT string_agg(l, ', ' ORDER BY l) FROM (SELECT count(*) || ' ' || type AS l FROM ({_TYPES}) GROUP BY type)) "
    f"AS by_type, {_AVG('sanitize_latency_ms', 'sanitize_ms')}, {_AVG('total_latency_ms', 'total_ms')}, "
    f"(SELECT string_agg(domain, ',' ORDER BY requests DESC, domain) FROM ({_TOP})) AS domains, "
    f'(SELECT string_agg("timestamp", \',\' ORDER BY "timestamp" DESC, event_id DESC) FROM ({_RECENT})) AS recent '
    f"FROM ({tables.AUDIT_SQL})",
    "stats_json": "SELECT 'stopped' AS status, count(*) AS requests, "
    f"(SELECT count(*) FROM ({_TYPES}) WHERE type = 'EMAIL') AS email, {_AVG('upstream_latency_ms', 'upstream_ms')}, "
    f"(SELECT domain FROM ({_TOP}) ORDER BY requests DESC, domain LIMIT 1) AS first_domain, "
    f'(SELECT max("timestamp") FROM ({tables.AUDIT_SQL})) AS newest FROM ({tables.AUDIT_SQL})',
    "trace_durations": f"SELECT id, {_between('start_ts', 'end_ts')} AS total_us, "
    f"{_between('sanitize_start', 'sanitize_end')} AS sanitize_us, {_between('upstream_start', 'first_byte')} AS ttfb_us, "
    f"{_between('upstream_start', 'upstream_end')} AS upstream_us, "
    f"{_between('response_start', 'response_end')} AS response_us, "
    f"{_between('start_ts', 'first_byte')} AS first_byte_us FROM ({tables.TRACES_SQL})",
}
ORACLES["live_snapshot"] = ORACLES["stats_snapshot"]
