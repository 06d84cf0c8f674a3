"""Queries that restore texts arriving in chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators import masking
from maskwright.plans import tables
from maskwright.session import scratch_dir, written
from maskwright.streaming.restore import restore_chunks, restore_stream

CHUNK = 97


def _masked(spark: SparkSession, folder: str) -> DataFrame:
    """The masked documents as the masking job leaves them, as a table."""
    masked = masking.sanitize(tables.planted(spark, folder))
    return written(masked.select(F.col("doc_id").cast("string").alias("session_id"), "masked", "items"), "masked")


def _chunks(masked: DataFrame) -> DataFrame:
    """Masked documents cut every few characters, through placeholders as it happens."""
    # The text is cut in one go: cutting a chunk out of the whole text walks it from its beginning each time.
    parts = F.regexp_extract_all("masked", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    filled = F.when(F.char_length("masked") > 0, parts).otherwise(F.array("masked"))
    cut = masked.select("session_id", filled.alias("parts")).select("session_id", "parts", F.size("parts").alias("n"))
    chunks = cut.select("session_id", "n", F.posexplode("parts").alias("seq", "data"))
    return chunks.select(
        "session_id", F.col("seq").cast("bigint").alias("seq"), "data", (F.col("seq") == F.col("n") - 1).alias("eof")
    )


def _report(restored: DataFrame, order: str) -> DataFrame:
    """The restored text of every session; a session here is one document."""
    parts = F.array_sort(F.collect_list(F.struct(order, "data")))
    return restored.groupBy("session_id").agg(F.array_join(parts["data"], "").alias("text"))


def chunks_batch(spark: SparkSession, folder: str) -> DataFrame:
    masked = _masked(spark, folder)
    known = masking.build_mappings(masked, "session_id")
    return _report(restore_chunks(_chunks(masked), known), "block")


def chunks_stream(spark: SparkSession, folder: str) -> DataFrame:
    masked = _masked(spark, folder)
    known = masking.build_mappings(masked, "session_id")
    source, output = scratch_dir(spark, "chunks"), scratch_dir(spark, "restored")
    chunks = _chunks(masked)
    chunks.write.parquet(source)
    stream = spark.readStream.schema(chunks.schema).parquet(source)
    restore_stream(stream, known, output, scratch_dir(spark, "checkpoint"), available_now=True).awaitTermination()
    return _report(spark.read.parquet(output), "seq")


QUERIES = {"restore_chunks": chunks_batch, "restore_stream": chunks_stream}

_TEXTS = f"SELECT CAST(doc_id AS VARCHAR) AS session_id, text FROM ({tables.PLANTED_SQL})"
ORACLES = {"restore_chunks": _TEXTS, "restore_stream": _TEXTS}
