"""The whole snapshot of a log, kept up to date while the log grows.

Each batch of events is summed up once, on all executors, into counts by kind and name, and added to the counts of the batch
before; the newest requests are kept the same way. From that small state the snapshot is made after every batch. The state
of a batch is a table of its own, named by the batch's number, so a batch that is run again starts from the same state and
replaces what it wrote; the checkpoint of the stream says which batch is next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from maskwright.fixed_values import RECENT_REQUESTS, TOP_DOMAINS
from maskwright.functions.labels import trimmed
from maskwright.operators import stats
from maskwright.session import delete_folder, scratch_scope, written

LATENCIES = {"sanitize_ms": "sanitize_latency_ms", "upstream_ms": "upstream_latency_ms", "total_ms": "total_latency_ms"}
COUNTS = "what string, name string, n bigint, total double"
WINDOW = stats.MINUTES * 60_000_000


def counts_of(audit: DataFrame) -> DataFrame:
    """(what, name, n, total) of events: `all`; by `host` and `type`; values and sum of each latency; events `at` a microsecond.

    One aggregate, summed up before it is shuffled, so a host or minute with most of the events does no harm.
    """

    def entry(what: str, name: Column, total: Column | None = None) -> Column:
        amount = F.lit(0.0) if total is None else F.coalesce(total, F.lit(0.0))
        return F.struct(F.lit(what).alias("what"), name.alias("name"), amount.alias("total"))

    types = F.coalesce(F.col("sanitized_items")["type"], F.array().cast("array<string>"))
    micros = F.unix_micros(stats.event_time(F.col("timestamp"))).cast("string")
    entries = F.concat(
        F.array(
            entry("all", F.lit("all")),
            entry("host", trimmed(F.col("host"))),
            entry("at", micros),
            *[entry(n, F.when(F.col(c) > 0, F.lit("ms")), F.col(c)) for n, c in LATENCIES.items()],
        ),
        F.transform(types, lambda t: entry("type", F.upper(trimmed(t)))),
    )
    long = audit.select(F.explode(entries).alias("e")).select("e.*").filter("name <> ''")
    return long.groupBy("what", "name").agg(F.count("*").alias("n"), F.sum("total").alias("total"))


def _figures(counts: DataFrame, now: Column) -> DataFrame:
    """The one row of figures of a snapshot from the counts."""
    age = F.unix_micros(now.cast("timestamp")) - F.when(F.col("what") == "at", F.col("name")).cast("bigint")
    slot = F.when((age >= 0) & (age < WINDOW), F.lit(stats.MINUTES - 1) - F.floor(age / 60_000_000))

    def n(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")

    def mean(what: str) -> Column:
        own = F.col("what") == what
        return F.coalesce(F.sum(F.when(own, F.col("total"))) / F.nullif(F.sum(F.when(own, F.col("n"))), F.lit(0)), F.lit(0.0))

    return counts.agg(
        n(F.col("what") == "all").alias("total"),
        F.array(*[n(slot == i) for i in range(stats.MINUTES)]).alias("last_5_minute"),
        n(F.col("what") == "type").alias("masked"),
        *[mean(name).alias(name) for name in LATENCIES],
    )


def snapshot_of(
    counts: DataFrame, latest: DataFrame, now: Column, order: list[str], status: str = "running", top_n: int = TOP_DOMAINS
) -> DataFrame:
    """The snapshot, as `stats.snapshot` gives it, from counts and the newest requests."""
    types = counts.filter("what = 'type'").select(F.col("name").alias("type"), "n")
    domains = counts.filter("what = 'host'").select(F.col("name").alias("domain"), F.col("n").alias("requests"))
    top = domains.orderBy(F.desc("requests"), "domain").limit(top_n)
    return stats.snapshot_row(_figures(counts, now), types, top, latest, order, status)


def newest_event(counts: DataFrame) -> Column:
    """The time of the newest event that was counted."""
    return counts.filter("what = 'at'").agg(F.max(F.timestamp_micros(F.col("name").cast("bigint")))).scalar()


def watch_snapshot(
    audit: DataFrame,
    output: str,
    state: str,
    checkpoint: str,
    order: list[str] | None = None,
    now: Callable[[], Column] | None = None,
    trigger: dict | None = None,
    status: str = "running",
    top_n: int = TOP_DOMAINS,
    recent_n: int = RECENT_REQUESTS,
) -> StreamingQuery:
    """Write the snapshot of all events so far after every batch of a stream, to `output`/batch_id=N (Parquet).

    `now` gives the time of a snapshot; without it that is the time of its newest event. Nothing is late: every event
    counts whenever it comes. `order` names the columns of the log order (the timestamp). The state, below `state`, is the counts by
    host and type, the times within five minutes of the newest event and the newest requests; only that of the last two batches is kept.
    `trigger` is what a stream's trigger takes, two seconds if not given.
    """
    order = order or ["timestamp"]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        here, before = f"{state}/batch-{batch_id}", f"{state}/batch-{batch_id - 1}"
        with scratch_scope(spark):
            events = written(batch, "snapshot-events")
            counts, latest = counts_of(events), stats.recent(events, order, recent_n)
            if batch_id:
                known = spark.read.schema(COUNTS).parquet(f"{before}/counts")
                both = counts.unionByName(known).groupBy("what", "name")
                counts = both.agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
                latest = latest.unionByName(spark.read.schema(latest.schema).parquet(f"{before}/latest"))
                latest = latest.orderBy(*[F.desc(f"log_{c}") for c in order]).limit(recent_n)
            counts = written(counts, "snapshot-counts")
            # older times than five minutes before the newest event can't come into a later snapshot
            old = F.col("name").cast("bigint") <= F.unix_micros(newest_event(counts)) - WINDOW
            counts = counts.filter((F.col("what") != "at") | ~F.coalesce(old, F.lit(False)))
            counts.write.mode("overwrite").parquet(f"{here}/counts")
            latest.write.mode("overwrite").parquet(f"{here}/latest")
            counts = spark.read.schema(COUNTS).parquet(f"{here}/counts")
            latest = spark.read.schema(latest.schema).parquet(f"{here}/latest")
            at = now() if now else newest_event(counts)
            snapshot_of(counts, latest, at, order, status, top_n).write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")
        if batch_id > 1:
            delete_folder(spark, f"{state}/batch-{batch_id - 2}")

    writer = audit.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "2 seconds"})).start()
