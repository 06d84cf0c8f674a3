"""Which requests and responses are handled, and what is recorded of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.fixed_values import PREVIEW_LENGTH, TRACE_SAMPLE_RATE


def _mentions(content_type: Column, what: str) -> Column:
    return F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit(what))


def request_skip_reason(
    method: Column, content_type: Column, content_length: Column, body: Column, limit: int | None = None
) -> Column:
    """Why a request is passed on as it is; NULL if it is to be masked.

    Without a limit the body itself decides. With one, in bytes, a longer body is passed on, and so is one whose
    declared length is longer or unknown.
    """
    size = F.octet_length(body)
    reason = (
        F.when(F.coalesce(method != "POST", F.lit(True)), F.lit("method"))
        .when(body.isNull(), F.lit("no body"))
        .when(_mentions(content_type, "text/event-stream"), F.lit("event stream"))
        .when(~_mentions(content_type, "application/json"), F.lit("content type"))
    )
    if limit is not None:
        reason = reason.when(content_length.isNull() | (content_length < 0), F.lit("unknown length")).when(
            (content_length > limit) | (size > limit), F.lit("too large")
        )
    return reason.when(size == 0, F.lit("empty"))


def is_streaming(content_type: Column, transfer_encoding: Column) -> Column:
    chunked = F.exists(transfer_encoding, lambda e: F.lower(e) == "chunked")
    return _mentions(content_type, "text/event-stream") | F.coalesce(chunked, F.lit(False))


def is_text(content_type: Column) -> Column:
    known = ["application/json", "application/x-www-form-urlencoded", "text/"]
    found = F.lit(False)
    for what in known:
        found = found | _mentions(content_type, what)
    return found


def response_skip_reason(
    content_type: Column,
    transfer_encoding: Column,
    content_encoding: Column,
    content_length: Column,
    body: Column,
    restore_enabled: Column,
    has_mapping: Column,
    limit: int | None = None,
) -> Column:
    """Why a response is passed on as it is; NULL if its placeholders are to be restored. `limit` as for requests."""
    streaming = is_streaming(content_type, transfer_encoding)
    reason = (
        F.when(~is_text(content_type) & ~streaming, F.lit("content type"))
        .when(F.coalesce(content_encoding, F.lit("")) != "", F.lit("compressed"))
    )
    if limit is not None:
        reason = reason.when(~streaming & (content_length.isNull() | (content_length < 0)), F.lit("unknown length")).when(
            ~streaming & (content_length > limit), F.lit("too large")
        )
    reason = (
        reason.when(~F.coalesce(restore_enabled, F.lit(False)), F.lit("restore off"))
        .when(~F.coalesce(has_mapping, F.lit(False)), F.lit("no mapping"))
        .when(body.isNull(), F.lit("no body"))
    )
    return reason if limit is None else reason.when(~streaming & (F.octet_length(body) > limit), F.lit("too large"))


def body_preview(body: Column, content_type: Column) -> Column:
    """The start of a JSON body on one line; empty for other bodies."""
    start = F.replace(F.left(body, F.lit(PREVIEW_LENGTH)), F.lit("\n"), F.lit(""))
    return F.when(_mentions(content_type, "application/json"), F.coalesce(start, F.lit(""))).otherwise(F.lit(""))


def audit_record(df: DataFrame) -> DataFrame:
    """Audit rows of requests that carry decision, reason, rule_id and items. Originals are not recorded."""
    has = set(df.columns)

    def optional(name: str, type_: str) -> Column:
        return (F.col(name) if name in has else F.lit(None)).cast(type_).alias(name)

    items = F.transform(F.col("items"), lambda i: F.struct(i["type"].alias("type"), i["placeholder"].alias("placeholder")))
    return df.select(
        optional("timestamp", "string"),
        "method",
        "host",
        optional("path", "string"),
        optional("status_code", "int"),
        "decision",
        F.concat("reason", F.lit(" ("), "rule_id", F.lit(")")).alias("reason"),
        optional("sanitize_latency_ms", "double"),
        optional("upstream_latency_ms", "double"),
        optional("total_latency_ms", "double"),
        optional("request_body_preview", "string"),
        optional("response_body_preview", "string"),
        (F.size("items") > 0).alias("sanitized"),
        items.alias("sanitized_items"),
    )


def _micros_between(start: str, end: str) -> Column:
    """Microseconds from start to end; 0 if either is missing or the end comes first."""
    span = F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))
    return F.greatest(F.coalesce(span, F.lit(0)), F.lit(0))


def trace_durations(traces: DataFrame) -> DataFrame:
    """Add the durations of a request in microseconds."""
    return traces.withColumns(
        {
            "total_us": _micros_between("start_ts", "end_ts"),
            "sanitize_us": _micros_between("sanitize_start", "sanitize_end"),
            "ttfb_us": _micros_between("upstream_start", "first_byte"),
            "upstream_us": _micros_between("upstream_start", "upstream_end"),
            "response_us": _micros_between("response_start", "response_end"),
            "first_byte_us": _micros_between("start_ts", "first_byte"),
        }
    )


def sample_traces(traces: DataFrame, key: str = "id", rate: float = TRACE_SAMPLE_RATE) -> DataFrame:
    """Keep this share of the requests, the same ones on every run and in every engine: by the MD5 of the key."""
    place = F.conv(F.left(F.md5(F.col(key).cast("string").cast("binary")), F.lit(8)), 16, 10).cast("long")
    return traces.filter(place % 1_000_000 < round(rate * 1_000_000))
