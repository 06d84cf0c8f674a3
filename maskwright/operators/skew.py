"""Joins and rankings that hold when one key has a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 1024


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join by columns of the same names in which NULL equals NULL; they appear once, from the left."""
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return left.join(renamed, same, how).drop(*[f"__r_{c}" for c in on])


def hot_split_join(
    left: DataFrame, right: DataFrame, on: list[str], spread_by: list[str], how: str = "left", parts: int = PARTS
) -> DataFrame:
    """Equi-join in which no key of `left` keeps more than about 1/`parts` of the rows in one place.

    A key is hot when it has at least that share. There can be no more than `parts` such keys, so the table of hot
    keys may be broadcast whatever the size of the inputs. The rows of a hot key are dealt out by a hash of
    `spread_by` and its rows of `right`, unique or few, are repeated for every share. `left` is read twice, so what
    is costly to compute should be a written table. NULL keys meet NULL keys.
    """
    counts = left.groupBy(*on).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n")).scalar()
    hot = (
        counts.withColumn("__total", total)
        .filter(F.col("__n") * parts >= F.col("__total"))
        .filter(F.col("__n") > parts)
        .select(*on, F.ceil(F.col("__n") * parts / F.col("__total")).cast("int").alias("__pieces"))
    )
    slot = F.pmod(F.xxhash64(*spread_by), F.col("__pieces")).cast("int")
    dealt = (
        null_safe_join(left, F.broadcast(hot), on)
        .withColumn("__slot", F.coalesce(slot, F.lit(0)))
        .drop("__pieces")
    )
    repeated = (
        null_safe_join(right, F.broadcast(hot), on)
        .withColumn("__slot", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__pieces"), F.lit(1)) - 1)))
        .drop("__pieces")
    )
    return null_safe_join(dealt, repeated, [*on, "__slot"], how).drop("__slot")


def running_total(
    df: DataFrame, group: list[str], order: list[str], block: int, amount: Column, into: str
) -> DataFrame:
    """Sum of `amount` over the earlier rows of `group` by `order`, without a whole group in one task.

    Rows are summed within blocks of the first order column, an integer, and the sums of the earlier blocks are
    added. A group of any size is spread over its blocks; only one row per block meets in the sum over blocks.
    """
    # The place is one column that is never NULL: the join on it takes the rows as the window has dealt them out.
    place = F.struct(*group, F.floor(F.col(order[0]) / block).alias("__block"))
    blocked = df.withColumn("__place", place).withColumn("__amount", amount)
    sums = blocked.groupBy("__place").agg(F.sum("__amount").alias("__sum"))
    earlier = Window.partitionBy(*[F.col(f"__place.`{c}`") for c in group]).orderBy("__place.__block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sums.select("__place", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    inner = Window.partitionBy("__place").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = blocked.withColumn("__within", F.coalesce(F.sum("__amount").over(inner), F.lit(0)))
    return (
        within.join(offsets, "__place")
        .withColumn(into, F.col("__within") + F.col("__before"))
        .drop("__place", "__amount", "__within", "__before")
    )


def rank_in_order(
    df: DataFrame, group: list[str], order: list[str], block: int, into: str = "rank"
) -> DataFrame:
    """Row number within `group` by `order`, computed as a running total."""
    counted = running_total(df, group, order, block, F.lit(1), into)
    return counted.withColumn(into, F.col(into) + 1)


def broadcast_if_small(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """Mark a table for broadcast only after counting that it has at most `max_rows` rows."""
    small = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df) if small else df), small
