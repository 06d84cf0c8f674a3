"""Names and labels of types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.fixed_values import NER_TYPE_NAMES
from maskwright.functions.hosts import WHITE_SPACE


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def unique_types(types: Column) -> Column:
    """Distinct trimmed non-empty types of an array, in the order first seen."""
    return F.array_distinct(F.filter(F.transform(types, trimmed), lambda t: t != ""))


def masked_counts(types: Column) -> Column:
    """Map from upper-case type to its count in an array of types; blank types do not count."""
    upper = F.array_sort(F.filter(F.transform(types, lambda t: F.upper(trimmed(t))), lambda t: t != ""))
    return F.map_from_entries(
        F.transform(
            F.array_distinct(upper),
            lambda t: F.struct(
                t.alias("type"),
                (F.size(upper) - F.size(F.array_remove(upper, t))).cast("bigint").alias("n"),
            ),
        )
    )


def masked_label(counts: Column) -> Column:
    """A map of counts as text such as "2 EMAIL, 1 JWT", sorted; "-" when empty."""
    parts = F.transform(F.map_entries(counts), lambda e: F.concat_ws(" ", e["value"].cast("string"), e["key"]))
    return F.when(F.size(parts) > 0, F.array_join(F.array_sort(parts), ", ")).otherwise(F.lit("-"))


def ner_type(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in NER_TYPE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.upper(name)), F.upper(name))
