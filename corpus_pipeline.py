"""A corpus prepared for training: each stage takes the documents that the one before it kept.

Every stage but the last returns the columns of `documents`; its filters and changes take effect for the next ones. The
SQL for the whole is None: learned scores, context patterns and token ids are beyond it; tests compare each stage with a
plain version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import byte_bpe, decontamination, near_duplicates, personal_data, toxicity
from maskwright.llm.common import hashed_remainder, table
from maskwright.session import written

ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """`text`, and the other columns as one, so that no name of theirs meets one that a stage gives."""
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__doc"))


def _unpacked(packed: DataFrame, columns: list[str]) -> DataFrame:
    return packed.select(*[F.col("text") if c == "text" else F.col(f"__doc.`{c}`") for c in columns])


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; learned from the labelled ones outside the held-out fifth."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    known = docs.select("doc_id", "text").join(labels, "doc_id").filter(hashed_remainder("doc_id", 5) != 0)
    scored = toxicity.score_texts(_packed(docs), toxicity.fit_lexicon(known), keep_text=True)
    return _unpacked(scored.filter("predicted = 0"), docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id, one without an id only if none has one.

    Rows are linked under a number of their own: rows without an id and rows that repeat one are judged by their texts too.
    """
    rows = written(_packed(docs).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = near_duplicates.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"))
    numbers = rows.select("__row", F.col("__doc.doc_id").alias("id"))
    parts = numbers.join(found.select(F.col("doc_id").alias("__row"), "component_id"), "__row")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "__row")).alias("least")
    kept = parts.groupBy("component_id").agg(least).select("least.__row")
    return _unpacked(rows.join(kept, "__row", "left_semi"), docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in benchmark windows.

    Texts, not ids, decide: documents without an id are judged like any other.
    """
    digests = {"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")}
    judged = docs.select("text").withColumns(digests)
    found = decontamination.find_items(judged, table(spark, sf_dir, "benchmark"), ["k1", "k2"], near=0)
    bad = found.filter(decontamination.CONTAMINATED).select("k1", "k2").distinct()
    return _unpacked(_packed(docs).withColumns(digests).join(bad, ["k1", "k2"], "left_anti"), docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with what was found replaced by the name of its kind. NULL texts stay NULL."""
    named = _packed(docs).withColumn("__text", F.col("text"))
    found = personal_data.find_spans(named, ["__doc", "__text"])
    masked = F.when(F.col("__text").isNotNull(), F.expr(personal_data.mask("__text", "spans")))
    count = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return _unpacked(found.withColumn("text", masked), docs.columns).withColumns(count)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids, with the text that the ids decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode_texts(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN)
    decoded = F.col("decoded").cast("string").alias("text")
    return encoded.select("doc_id", "lang", "source", decoded, "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("personal_data", mask_personal_data),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
