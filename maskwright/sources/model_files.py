"""Label and vocabulary files of a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators.wordpiece import special_ids


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels `{"0": "O", ...}` as (id, label). A key that is not an integer is an error."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})))
    bad = F.raise_error(F.concat(F.lit("invalid label key "), F.col("key")))
    number = F.when(F.col("key").rlike(r"^[+-]?\d+$"), F.col("key").cast("int")).otherwise(bad.cast("int"))
    return pairs.select(number.alias("id"), F.col("value").alias("label"))


def load_vocab(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """The pieces (piece, id) of a tokenizer file and whether it lower-cases; the special pieces must be there."""
    schema = "model struct<vocab:map<string,int>>, normalizer struct<lowercase:boolean>"
    text = spark.read.text(path, wholetext=True)
    config = text.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("c"))
    lowercase = config.select(F.coalesce("c.normalizer.lowercase", F.lit(True))).first()[0]
    vocab = config.select(F.explode("c.model.vocab").alias("piece", "id"))
    special_ids(vocab)
    return vocab, lowercase
