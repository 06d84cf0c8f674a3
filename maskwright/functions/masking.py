"""Masking and restoring one text, as expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.fixed_values import PLACEHOLDER_PATTERN
from maskwright.functions.arrays import empty, fresh, let, quoted
from maskwright.functions.spans import ITEM, NO_SPANS, PLACED, items_of, number_spans, rebuild, resolve


def chosen_spans(spans: str, max_replacements: int = 0, overlap: str = "first_longest") -> str:
    """Overlaps resolved and the limit on replacements applied; a text without spans costs nothing."""

    def choose(found: str) -> str:
        kept = resolve(found, overlap)
        kept = f"slice({kept}, 1, {max_replacements})" if max_replacements > 0 else kept
        return f"if(size({found}) > 0, {kept}, {NO_SPANS})"

    return let(spans, choose)


def placed_spans(spans: str) -> str:
    """Disjoint spans with their placeholders."""
    return let(spans, lambda found: f"if(size({found}) > 0, {number_spans(found)}, {empty(PLACED)})")


def masked_text(text: str, placed: str) -> str:
    return f"if(size({placed}) > 0, {rebuild(text, placed)}, {text})"


def masked_items(placed: str) -> str:
    return f"if(size({placed}) > 0, {items_of(placed)}, {empty(ITEM)})"


def with_masked(
    df: DataFrame, text: str, spans: str, max_replacements: int = 0, overlap: str = "first_longest"
) -> DataFrame:
    """Add `masked` and `items` for the given spans of a text. One step per column keeps each step small."""
    return (
        df.withColumn("__chosen", F.expr(chosen_spans(spans, max_replacements, overlap)))
        .withColumn("__placed", F.expr(placed_spans("__chosen")))
        .withColumn("masked", F.expr(masked_text(text, "__placed")))
        .withColumn("items", F.expr(masked_items("__placed")))
        .drop("__chosen", "__placed")
    )


def placeholders_in(text: str) -> str:
    """Everything in the text that has the shape of a placeholder, in order."""
    found = f"regexp_extract_all({text}, {quoted(PLACEHOLDER_PATTERN)}, 0)"
    return f"if(contains({text}, '['), {found}, {empty('string')})"


def put_back(text: str, originals: str) -> str:
    """Replace the placeholders of a text, in one pass, by the values at the same positions of `originals`."""
    gap, i = fresh("gap"), fresh("i")
    return let(
        f"split({text}, {quoted(PLACEHOLDER_PATTERN)}, -1)",
        lambda gaps: f"array_join(transform({gaps}, ({gap}, {i}) -> "
        f"concat({gap}, coalesce(get({originals}, {i}), ''))), '')",
    )
