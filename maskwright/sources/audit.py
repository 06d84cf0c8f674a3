"""The audit log: JSON lines, read, written and followed."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.fixed_values import FOLLOW_TAIL
from maskwright.sources.appended import follow_lines

AUDIT_SCHEMA = (
    "timestamp string, method string, host string, path string, status_code int, decision string, reason string, "
    "sanitize_latency_ms double, upstream_latency_ms double, total_latency_ms double, "
    "request_body_preview string, response_body_preview string, sanitized boolean, "
    "sanitized_items array<struct<type:string,placeholder:string>>"
)
ALWAYS_WRITTEN = ["timestamp", "method", "host", "decision", "reason"]


def parse_audit(lines: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Audit rows of a table of text lines. Lines that do not parse, or are longer than `max_bytes`, are left out."""
    if max_bytes is not None:
        lines = lines.filter(F.octet_length("value") <= max_bytes)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt", "allowSingleQuotes": "false"}
    row = F.from_json("value", f"{AUDIT_SCHEMA}, __corrupt string", options)
    return (
        lines.filter(F.col("value").rlike(r"^\s*\{"))
        .select(row.alias("row"))
        .select("row.*")
        .filter(F.col("__corrupt").isNull())
        .drop("__corrupt")
    )


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The audit table of a JSONL file or folder; a path that does not exist is an empty log."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], AUDIT_SCHEMA)
    return parse_audit(lines)


def rfc3339(timestamp: Column) -> Column:
    """A timestamp in UTC as text without trailing zeros in the fraction."""
    utc = F.to_utc_timestamp(timestamp, F.current_timezone())
    return F.concat(
        F.regexp_replace(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", ""), F.lit("Z")
    )


def _compact(df: DataFrame) -> DataFrame:
    """Empty values as NULL, which the JSON writer leaves out; the leading fields are always written."""
    columns = []
    for name, type_ in df.dtypes:
        value = F.col(name)
        if name in ALWAYS_WRITTEN:
            columns.append(F.coalesce(value, F.lit("")).alias(name))
        elif type_ == "string":
            columns.append(F.nullif(value, F.lit("")).alias(name))
        elif type_ == "boolean":
            columns.append(F.when(value, value).alias(name))
        elif type_.startswith("array"):
            columns.append(F.when(F.size(value) > 0, value).alias(name))
        else:
            columns.append(F.when(value != 0, value).alias(name))
    return df.select(*columns)


def write_audit(df: DataFrame, path: str, stamp: bool = True) -> None:
    """Append audit rows as JSON lines, each stamped with the time of writing."""
    if stamp:
        df = df.withColumn("timestamp", rfc3339(F.current_timestamp()))
    known = [c.split()[0] for c in AUDIT_SCHEMA.split(", ")]
    _compact(df.select(*[c for c in known if c in df.columns])).write.mode("append").json(path)


def audit_tail(audit: DataFrame, order: list[str], n: int = FOLLOW_TAIL) -> DataFrame:
    """The last rows of a log, oldest first: what is shown before it is followed. `order` names the columns of the log order.

    Each task keeps its own last rows, so only those meet.
    """
    return audit.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def follow_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The audit rows of new files in a folder, as a stream; `audit_tail` of `read_audit` gives what came before."""
    return parse_audit(spark.readStream.text(folder))


def follow_appended(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The audit rows of lines as they are appended to a log, or to the logs of a folder, as a stream; each line once, also
    after a restart or when the log is rotated. Options as in `sources.appended`."""
    return parse_audit(follow_lines(spark, path, **options))


def write_report(report: DataFrame, path: str) -> None:
    """Write the recent-requests report as CSV with a header."""
    report.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
