"""What the operators of this folder share: reading tables, batches in tasks, hashes of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def hashed_remainder(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; 0 for a NULL key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def row_map(
    df: DataFrame, text: str, schema: str, make: Callable[[], Callable[[str | None], tuple]], batch: int = 64
) -> DataFrame:
    """The table with columns computed from one text column, row by row inside Arrow batches.

    `make` runs once per task and gives the function for one text; what it builds (vocabulary, caches) lives as long.
    The text column goes unless it is among the new ones; columns that clash with a new one are replaced. Batches are cut to `batch` rows, so that a few very
    long texts do not meet in one piece of output.
    """
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(schema)
    kept = [f for f in df.schema.fields if f.name != text and f.name not in new.names]
    names = [f.name for f in kept]
    arrow_new = _arrow_schema(df.sparkSession, new)
    source = df.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{text}`").alias("__in"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                rows = [one(x.as_py()) for x in part.column(len(names))]
                made = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow_new)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*names, *new.names])

    return source.mapInArrow(run, StructType([*kept, *new.fields]))


def _arrow_schema(spark: SparkSession, schema) -> list:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(schema))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, limit: int = 300_000):
        self.limit, self.known = limit, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > self.limit:
            known.clear()
        new = set(words).difference(known)
        for w in new:
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


SHINGLE = 5
_FACTORS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64
)


def shingles(text: str | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of five words; of all its words if it has fewer.

    A-Z are lower-cased; words are what stands between ASCII white space. Equal hashes stand for equal runs: two
    different runs of one pair of texts meet with a chance of one in 2**64.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes(words)
    n = min(size, len(words))
    total = np.full(len(words) - n + 1, np.uint64(n), np.uint64)
    for i in range(n):
        total += h[i : len(words) - n + 1 + i] * _FACTORS[i % len(_FACTORS)]
    return np.unique(mixed(total))
