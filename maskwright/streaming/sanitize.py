"""Masking a stream of requests."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from maskwright.functions.hosts import normalize_host
from maskwright.functions.spans import ITEM
from maskwright.operators.jsonmask import sanitize_body
from maskwright.operators.masking import build_mappings
from maskwright.operators.policy import evaluate_policy
from maskwright.operators.traffic import audit_record, body_preview, request_skip_reason
from maskwright.session import scratch_scope, written


def mask_requests(
    requests: DataFrame,
    rules: Iterable[Mapping] = (),
    types: Iterable[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Requests with decision, skip reason, masked body and items; works on tables and streams.

    `requests` is (request_id, timestamp, method, host, path, content_type, content_length, body). A body that is
    not to be masked does not reach the detectors.
    """
    named = requests.withColumn("host", normalize_host(F.col("host")))
    decided = evaluate_policy(named, rules)
    reason = request_skip_reason(
        F.col("method"), F.col("content_type"), F.col("content_length"), F.col("body"), limit
    )
    blocked = F.when(F.col("decision") == "block", F.lit("blocked"))
    with_reason = decided.withColumn("skip_reason", F.coalesce(blocked, reason)).withColumn(
        "__body", F.when(F.col("skip_reason").isNull(), F.col("body"))
    )
    masked = sanitize_body(with_reason, "__body", types)
    return masked.withColumns(
        {
            "masked": F.when(F.col("skip_reason").isNull(), F.col("masked")).otherwise(F.col("body")),
            "items": F.when(F.col("skip_reason").isNull(), F.col("items")).otherwise(
                F.array().cast(f"array<{ITEM}>")
            ),
            # Only of bodies the detectors have seen: originals do not enter the audit log.
            "request_body_preview": F.when(
                F.col("skip_reason").isNull(), body_preview(F.col("masked"), F.col("content_type"))
            ).otherwise(F.lit("")),
        }
    ).drop("__body", "is_json")


def sanitize_stream(
    requests: DataFrame,
    output: str,
    checkpoint: str,
    rules: Iterable[Mapping] = (),
    types: Iterable[str] | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Mask a stream of requests into the folders `masked`, `mappings` and `audit` below `output`.

    The masked rows of a batch are written to the scratch folder first, with their items, and all three are made from
    what was written: the detectors run once. The scratch table holds originals and is deleted with the batch. A batch
    that is run again replaces what it wrote before.
    """
    rules = list(rules)

    def write(batch: DataFrame, batch_id: int) -> None:
        def put(df: DataFrame, name: str) -> None:
            df.write.mode("overwrite").parquet(f"{output}/{name}/batch_id={batch_id}")

        with scratch_scope(batch.sparkSession):
            done = written(mask_requests(batch, rules, types), "requests")
            put(done.select("request_id", "masked", "skip_reason"), "masked")
            put(build_mappings(done, "request_id"), "mappings")
            put(audit_record(done), "audit")

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
