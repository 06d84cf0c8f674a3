"""Host names: ports, connect targets, categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.fixed_values import HOST_CATEGORIES, UNKNOWN_CATEGORY

_BRACKETED = r"^\[([^\[\]]*)\]:([^:\[\]]*)\z"
_PLAIN = r"^([^:\[\]]*):([^:\[\]]*)\z"
WHITE_SPACE = " \t\n\v\f\r"


def normalize_host(host: Column) -> Column:
    """Host without port; what does not parse as host and port is cut at its first colon."""
    return (
        F.when(host.rlike(_BRACKETED), F.regexp_extract(host, _BRACKETED, 1))
        .when(host.rlike(_PLAIN), F.regexp_extract(host, _PLAIN, 1))
        .otherwise(F.substring_index(host, ":", 1))
    )


def connect_target(host: Column) -> Column:
    """Host with a port, 443 if it has none."""
    name = F.btrim(host, F.lit(WHITE_SPACE))
    return F.when((name == "") | F.contains(name, F.lit(":")), name).otherwise(F.concat(name, F.lit(":443")))


def classify_host(host: Column) -> Column:
    name = F.lower(host)
    category = F.lit(UNKNOWN_CATEGORY)
    for part, label in reversed(HOST_CATEGORIES):
        category = F.when(F.contains(name, F.lit(part)), F.lit(label)).otherwise(category)
    return category
