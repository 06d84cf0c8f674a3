"""Queries over texts: finding, resolving, masking, restoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.detectors import detect, detectors
from maskwright.functions.numbers import shannon_entropy
from maskwright.operators import masking
from maskwright.plans import oracle, tables
from maskwright.session import written

BASIC = ["email", "phone", "api_key", "jwt"]
DOCUMENTS = "SELECT doc_id, text FROM documents"


def _long(df: DataFrame) -> DataFrame:
    return masking.findings(df, ["doc_id"]).select(
        "doc_id",
        F.col("type").alias("span_type"),
        F.col("start").cast("bigint").alias("span_start"),
        F.col("end").cast("bigint").alias("span_end"),
        F.col("value").alias("span_value"),
        "score",
    )


_LONG = "doc_id, type AS span_type, s AS span_start, e AS span_end, value AS span_value, score"


def _find(name: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _long(detect(tables.documents(spark, folder), types=[name]))

    return query, f"WITH {oracle.spans_sql(DOCUMENTS, 'doc_id', [name])} SELECT {_LONG} FROM spans"


def find_secret(spark: SparkSession, folder: str) -> DataFrame:
    return _long(detect(tables.planted(spark, folder), types=["secret"]))


def entropy(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.documents(spark, folder)
    return docs.select("doc_id", F.round(F.expr(shannon_entropy("text")), 9).alias("entropy"))


def confidence_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _long(detect(tables.documents(spark, folder), types=BASIC, min_confidence=0.9))


def _resolved(overlap: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _long(masking.resolved_spans(tables.planted(spark, folder), overlap=overlap))

    ctes = oracle.spans_sql(tables.PLANTED_SQL, "doc_id")
    return query, f"WITH {ctes},\n{oracle.chosen_sql('doc_id', overlap)} SELECT {_LONG} FROM chosen"


def placeholders(spark: SparkSession, folder: str) -> DataFrame:
    masked = masking.sanitize(tables.planted(spark, folder))
    items = masked.select("doc_id", F.explode_outer("items").alias("i")).filter("i is not null")
    return items.select(
        "doc_id",
        F.col("i.type").alias("span_type"),
        F.col("i.original").alias("original"),
        F.col("i.placeholder").alias("placeholder"),
    )


def sanitize_documents(spark: SparkSession, folder: str) -> DataFrame:
    masked = masking.sanitize(tables.documents(spark, folder))
    return masked.select("doc_id", "masked", F.size("items").cast("bigint").alias("n_items"))


def max_replacements(spark: SparkSession, folder: str) -> DataFrame:
    masked = masking.sanitize(tables.planted(spark, folder), max_replacements=2)
    return masked.select("doc_id", "masked", F.size("items").cast("bigint").alias("n_items"))


def mappings(spark: SparkSession, folder: str) -> DataFrame:
    return masking.build_mappings(masking.sanitize(tables.planted(spark, folder)), "doc_id")


def _masked_table(spark: SparkSession, folder: str, types: list[str] | None) -> DataFrame:
    """The masked documents as the masking job leaves them, as a table, with the documents as sessions."""
    masked = masking.sanitize(tables.planted(spark, folder), types=types)
    return written(masked.withColumn("session", F.col("doc_id")), "masked")


def restore_text(spark: SparkSession, folder: str) -> DataFrame:
    """Answers that quote the masked documents; restoring is off for every fifth."""
    masked = _masked_table(spark, folder, BASIC)
    quote = F.concat(F.lit("You wrote: "), "masked", F.lit(" [EMAIL_99]"))
    answers = masked.select("doc_id", "session", quote.alias("text"))
    known = masking.build_mappings(masked, "session")
    restored = masking.restore(answers, known, "doc_id", "session", enabled="doc_id % 5 <> 0")
    return restored.select("doc_id", "restored")


def round_trip(spark: SparkSession, folder: str) -> DataFrame:
    masked = _masked_table(spark, folder, None)
    known = masking.build_mappings(masked, "session")
    restored = masking.restore(masked, known, "doc_id", "session", text="masked")
    return restored.select("doc_id", (F.col("restored") == F.col("text")).alias("same"))


def detector_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Names are trimmed, case-blind, and unknown ones ignored."""
    chosen = detectors([" EMAIL", "Phone ", "no such detector", "hex_secret"])
    found = _long(detect(tables.planted(spark, folder), types=chosen))
    return found.groupBy("span_type").agg(F.count("*").alias("n"))


def sanitize_conversations(spark: SparkSession, folder: str) -> DataFrame:
    masked, _ = masking.sanitize_conversations(tables.turns(spark, folder), types=BASIC)
    return masked.select("conv_id", "turn", "masked")


def conversation_mappings(spark: SparkSession, folder: str) -> DataFrame:
    _, known = masking.sanitize_conversations(tables.turns(spark, folder), types=BASIC)
    return known


# In SQL the turns of a conversation are joined by a mark that is in no pattern, masked as one text and cut again.
_MARK = "chr(1)"
_JOINED = (
    f"SELECT conv_id, string_agg(text, {_MARK} ORDER BY turn) AS text FROM ({tables.TURNS_SQL}) GROUP BY conv_id"
)
_CONVERSATIONS = oracle.sanitize_sql(_JOINED, "conv_id", BASIC)

_PLACED = oracle.sanitize_sql(tables.PLANTED_SQL, "doc_id")
_ITEMS = "SELECT DISTINCT doc_id, type AS span_type, value AS original, placeholder FROM placed"

_find_queries = {f"find_{name}": _find(name) for name in BASIC}
_resolved_queries = {f"resolve_{name}": _resolved(name) for name in ("first_longest", "prefer")}

QUERIES = {
    "sanitize_documents": sanitize_documents,
    **{name: query for name, (query, _) in _find_queries.items()},
    "find_secret": find_secret,
    "entropy": entropy,
    "confidence_filter": confidence_filter,
    **{name: query for name, (query, _) in _resolved_queries.items()},
    "placeholders": placeholders,
    "max_replacements": max_replacements,
    "mappings": mappings,
    "restore_text": restore_text,
    "round_trip": round_trip,
    "detector_registry": detector_registry,
    "sanitize_conversations": sanitize_conversations,
    "conversation_mappings": conversation_mappings,
}

ORACLES = {
    "sanitize_documents": oracle.sanitize_sql(DOCUMENTS, "doc_id") + " SELECT doc_id, masked, n_items FROM masked",
    **{name: sql for name, (_, sql) in _find_queries.items()},
    "find_secret": f"WITH {oracle.spans_sql(tables.PLANTED_SQL, 'doc_id', oracle.ALL_TYPES[4:])} "
    f"SELECT {_LONG} FROM spans",
    "entropy": f"SELECT doc_id, round({oracle.entropy_sql('text')}, 9) AS entropy FROM documents",
    "confidence_filter": f"WITH {oracle.spans_sql(DOCUMENTS, 'doc_id', BASIC, 0.9)} SELECT {_LONG} FROM spans",
    **{name: sql for name, (_, sql) in _resolved_queries.items()},
    "placeholders": f"{_PLACED} {_ITEMS}",
    "max_replacements": oracle.sanitize_sql(tables.PLANTED_SQL, "doc_id", limit=2)
    + " SELECT doc_id, masked, n_items FROM masked",
    "mappings": f"{_PLACED} SELECT DISTINCT doc_id, placeholder, value AS original FROM placed",
    "restore_text": oracle.sanitize_sql(tables.PLANTED_SQL, "doc_id", BASIC)
    + " SELECT src.doc_id AS doc_id, 'You wrote: ' || CASE WHEN src.doc_id % 5 <> 0 THEN text ELSE masked END "
    "|| ' [EMAIL_99]' AS restored FROM src JOIN masked ON src.doc_id = masked.doc_id",
    "round_trip": "SELECT doc_id, true AS same FROM documents",
    "detector_registry": f"WITH {oracle.spans_sql(tables.PLANTED_SQL, 'doc_id', ['email', 'phone', 'hex_secret'])} "
    "SELECT type AS span_type, count(*) AS n FROM spans GROUP BY type",
    "sanitize_conversations": f"{_CONVERSATIONS} SELECT conv_id, turn, part AS masked FROM ("
    f"SELECT conv_id, unnest(string_split(masked, {_MARK})) AS part, "
    f"unnest(range(len(string_split(masked, {_MARK})))) AS i FROM masked) JOIN ("
    "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) "
    "USING (conv_id, i)",
    "conversation_mappings": f"{_CONVERSATIONS} SELECT DISTINCT conv_id, placeholder, value AS original FROM placed",
}
