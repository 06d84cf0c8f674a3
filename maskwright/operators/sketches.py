"""Statistics that merge: quantiles and frequent names stored per minute, read for any stretch of time.

A minute's values are kept as sketches of bounded size, so a log of years is read as a few kilobytes a minute, and minutes that
are written once are never read from the log again. Merged sketches answer as if they had seen all values at once:

- Quantiles (KLL): the rank of an answer is off by at most about `1.33 / (k / 200) ** 0.9` percent of the values, with a
  chance of 99 %; 0.7 % at the default of k = 400. Numbers of values are exact.
- Frequent names: a count is too low by at most n / tracked, where n is the number of events; nothing is counted too high,
  and with fewer different names than three quarters of `tracked` the counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.labels import trimmed
from maskwright.operators.stats import event_time

KLL_K = 400
TRACKED = 1024
LATENCIES = {"sanitize_ms": "sanitize_latency_ms", "upstream_ms": "upstream_latency_ms", "total_ms": "total_latency_ms"}


def rank_error(k: int = KLL_K) -> float:
    """By what share of the values the rank of a quantile may be off, with a chance of 99 %."""
    return 0.0133 / (k / 200) ** 0.9


def _frequent(name: Column, tracked: int) -> Column:
    return F.call_function("approx_top_k_accumulate", F.nullif(name, F.lit("")), F.lit(tracked))


def minute_sketches(audit: DataFrame, by: Iterable[str] = (), k: int = KLL_K, tracked: int = TRACKED) -> DataFrame:
    """One row per minute (and the columns `by`): `minute`, `requests`, a sketch of each latency and one of the hosts.

    Latencies of zero or below, and blank hosts, don't count, as in the plain statistics; events whose time can't be read
    are left out. The log is summed up before it is shuffled, so a busy minute or host does no harm.
    """
    timed = audit.withColumn("minute", F.date_trunc("minute", event_time(F.col("timestamp"))))
    sketches = [
        F.kll_sketch_agg_double(F.when(F.col(c) > 0, F.col(c)), F.lit(k)).alias(n) for n, c in LATENCIES.items()
    ]
    hosts = _frequent(trimmed(F.col("host")), tracked).alias("hosts")
    return timed.filter("minute is not null").groupBy("minute", *by).agg(F.count("*").alias("requests"), *sketches, hosts)


def merge_sketches(sketches: DataFrame, by: Iterable[str] = (), k: int = KLL_K, tracked: int = TRACKED) -> DataFrame:
    """The rows of a table of sketches as one, or as one per group: `requests`, the latencies and `hosts`, as sketches again.

    An empty table gives an empty one.
    """
    by = list(by)
    merged = [F.kll_merge_agg_double(n, F.lit(k)).alias(n) for n in LATENCIES]
    hosts = F.call_function("approx_top_k_combine", F.col("hosts"), F.lit(tracked)).alias("hosts")
    # a constant group, for without one there would be a row of nothing for an empty table
    grouped = sketches.groupBy(*(by or [F.lit(1).alias("__all")]))
    return grouped.agg(F.sum("requests").alias("requests"), *merged, hosts).drop("__all")


def quantiles(merged: DataFrame, probabilities: Iterable[float], keep: Iterable[str] = ()) -> DataFrame:
    """`keep`, `what` (the latency), `n` (how many values), `p` and `value`; no rows for a latency without values."""
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    each = F.array(*[F.struct(F.lit(n).alias("what"), F.col(n).alias("s")) for n in LATENCIES])
    long = merged.select(*keep, F.explode(each).alias("x")).select(
        *keep, "x.what", "x.s", F.kll_sketch_get_n_double("x.s").alias("n")
    )
    found = long.filter("n > 0").withColumn("values", F.kll_sketch_get_quantile_double("s", wanted))
    pairs = F.explode(F.arrays_zip(wanted.alias("p"), F.col("values").alias("value"))).alias("pair")
    return found.select(*keep, "what", "n", pairs).select(*keep, "what", "n", "pair.p", "pair.value")


def frequent_hosts(merged: DataFrame, n: int, keep: Iterable[str] = ()) -> DataFrame:
    """`keep`, `host` and `n` of the `n` most frequent hosts, equal counts by name."""
    # hosts of equal count may stand in any order, so more are read than are wanted
    found = F.call_function("approx_top_k_estimate", F.col("hosts"), F.lit(max(4 * n, 32)))
    # NULL, which stands for blank hosts, is counted like a name
    found = F.filter(found, lambda x: x["item"].isNotNull())
    ordered = F.array_sort(F.transform(found, lambda x: F.struct((-x["count"]).alias("less"), x["item"].alias("host"))))
    long = merged.select(*keep, F.explode(F.slice(ordered, 1, n)).alias("x"))
    return long.select(*keep, "x.host", (-F.col("x.less")).alias("n"))
