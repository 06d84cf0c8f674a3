"""Masking tables of texts and conversations, and restoring them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.detectors import detect
from maskwright.functions.masking import chosen_spans, placeholders_in, put_back, with_masked
from maskwright.functions.spans import kind_of, rebuild
from maskwright.operators.entities import hybrid_detect
from maskwright.operators.skew import hot_split_join, null_safe_join, rank_in_order
from maskwright.session import written


def sanitize(
    df: DataFrame,
    text: str = "text",
    types: Iterable[str] | None = None,
    min_confidence: float = 0.0,
    max_replacements: int = 0,
    overlap: str | None = None,
    specific_first: bool = False,
    entities: DataFrame | None = None,
    key: str | list[str] | None = None,
) -> DataFrame:
    """Add `masked`, the text with placeholders, and `items`, what was replaced. Works row by row.

    With `entities`, the table of what a model found under `key` (see `hybrid_detect`), its spans are masked as well and
    overlaps are resolved by preference unless told otherwise.
    """
    if entities is not None:
        rule = overlap or "prefer"
        found = hybrid_detect(
            df, entities, key, text, types, into="__spans", min_confidence=min_confidence, overlap=rule
        )
        # The spans are disjoint by now: the second resolution only cuts to the limit.
        return with_masked(found, text, "__spans", max_replacements).drop("__spans")
    found = detect(df, text, types, min_confidence, specific_first, into="__spans")
    return with_masked(found, text, "__spans", max_replacements, overlap or "first_longest").drop("__spans")


def resolved_spans(
    df: DataFrame,
    text: str = "text",
    types: Iterable[str] | None = None,
    min_confidence: float = 0.0,
    overlap: str = "first_longest",
    into: str = "spans",
) -> DataFrame:
    """Add the array of disjoint spans that would be masked."""
    found = detect(df, text, types, min_confidence, into="__found")
    return found.withColumn(into, F.expr(chosen_spans("__found", overlap=overlap))).drop("__found")


def findings(df: DataFrame, keys: list[str], spans: str = "spans") -> DataFrame:
    """One row per span."""
    # The outer form keeps Spark from testing the size of the array, and so computing it, ahead of time.
    long = df.select(*keys, F.posexplode_outer(spans).alias("pos", "span"))
    return long.select(*keys, "pos", "span.*").filter(F.col("type").isNotNull())


def build_mappings(df: DataFrame, session: str, items: str = "items") -> DataFrame:
    """The table of what every placeholder of a session stands for."""
    long = df.select(F.col(session), F.explode_outer(items).alias("item"))
    return long.select(session, "item.placeholder", "item.original").filter(F.col("placeholder").isNotNull())


def drop_sessions(mappings: DataFrame, ended: DataFrame, session: str) -> DataFrame:
    """Mappings without those of ended sessions."""
    return mappings.join(ended.select(session).distinct(), session, "left_anti")


def restore(
    responses: DataFrame,
    mappings: DataFrame,
    key: str,
    session: str,
    text: str = "text",
    into: str = "restored",
    enabled: str = "true",
) -> DataFrame:
    """Put the originals back into texts, each from the mappings of its own session.

    `key` is unique per response, `(session, placeholder)` per mapping, `enabled` a condition on the response.
    Only places travel to the mappings, by way of a table in the scratch folder; a response meets its own
    originals again by `key`. A response without a bracket, or that is not to be restored, stays where it is. One pass
    per text, so an original that looks like a placeholder stays as it is, and so does a placeholder without a mapping.
    `responses` is read for each of these steps, so what is costly to compute should be a written table.
    """
    active = F.expr(f"coalesce({enabled}, false) and coalesce(contains({text}, '['), false)")
    asked = written(
        responses.filter(active)
        .select(key, session, F.posexplode_outer(F.expr(placeholders_in(text))).alias("pos", "placeholder"))
        .filter(F.col("placeholder").isNotNull()),
        "asked",
    )
    known = mappings.select(session, "placeholder", "original")
    answered = hot_split_join(asked, known, [session, "placeholder"], [key, "pos"])
    value = F.coalesce("original", "placeholder").alias("value")
    originals = answered.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", value))).alias("__found"))
    values = originals.select(key, F.expr("transform(__found, f -> f.value)").alias("__values"))
    filled = (
        responses.filter(active)
        .join(values, key, "left")
        .withColumn(into, F.expr(f"if(__values is null, {text}, {put_back(text, '__values')})"))
        .drop("__values")
    )
    return responses.filter(~active).withColumn(into, F.expr(text)).select(filled.columns).unionByName(filled)


def number_placeholders(
    occurrences: DataFrame, group: list[str], order: list[str], block: int = 1024
) -> DataFrame:
    """One row per distinct (type, value) of a group with its placeholder, numbered by first occurrence.

    `occurrences` has the group and order columns, `type` and `value`; the first order column is an integer.
    """
    first = (
        occurrences.groupBy(*group, F.expr(kind_of("type")).alias("kind"), "value")
        .agg(F.min(F.struct(*order)).alias("first"))
        .select(*group, "kind", "value", "first.*")
    )
    ranked = rank_in_order(first, [*group, "kind"], order, block, into="n")
    return ranked.select(
        *group,
        "kind",
        "value",
        "n",
        F.format_string("[%s_%d]", "kind", "n").alias("placeholder"),
    )


def sanitize_conversations(
    df: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    text: str = "text",
    types: Iterable[str] | None = None,
    min_confidence: float = 0.0,
    max_replacements: int = 0,
    block: int = 1024,
    overlap: str | None = None,
    entities: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Mask the turns of conversations with one set of placeholders per conversation.

    Returns the table with `masked` added, and the mappings (conversation, placeholder, original). A conversation
    of any length is spread over blocks of turns; what is gathered in one place is a single turn. The detectors run
    once, when this is called: their findings, without the texts, are kept as a table in the scratch folder. Turns
    without a conversation are one conversation of their own; turns of the same number are masked each by its text.
    `entities` is the table of what a model found by conversation and turn; turns without a number have none.
    """
    df = df.withColumn("__row", F.xxhash64(text))
    if entities is not None:
        by_turn, rule = [conversation, turn], overlap or "prefer"
        spans = hybrid_detect(df, entities, by_turn, text, types, min_confidence=min_confidence, overlap=rule)
    else:
        spans = resolved_spans(df, text, types, min_confidence, overlap or "first_longest")
    found = findings(spans, [conversation, turn, "__row"]).filter(F.trim("value") != "")
    occurrences = written(found.withColumn("kind", F.expr(kind_of("type"))), "occurrences")
    if max_replacements > 0:
        ranked = rank_in_order(occurrences, [conversation], [turn, "start", "__row"], block)
        occurrences = written(ranked.filter(F.col("rank") <= max_replacements).drop("rank"), "occurrences")
    numbered = written(number_placeholders(occurrences, [conversation], [turn, "start", "__row"], block), "numbered")
    placed = hot_split_join(
        occurrences, numbered, [conversation, "kind", "value"], [turn, "start", "__row"], how="inner"
    )
    per_turn = placed.groupBy(conversation, turn, "__row").agg(
        F.array_sort(F.collect_set(F.struct("start", "end", "placeholder"))).alias("__placed")
    )
    masked = (
        null_safe_join(df, per_turn, [conversation, turn, "__row"])
        .withColumn("masked", F.expr(f"if(__placed is null, {text}, {rebuild(text, '__placed')})"))
        .drop("__placed", "__row")
    )
    mappings = numbered.select(conversation, "placeholder", F.col("value").alias("original"))
    return masked, mappings
