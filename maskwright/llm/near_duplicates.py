"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

One permutation places a text's shingles on a circle of 2**32 places; a second one, shifted by 0, 1, 2 .. places along
the circle, gives all coordinates of the signature: each is the least value of the shifted permutation over the shingles.
Documents that agree in all rows of a band share a bucket. Sets that are equal are one document from the start.

Pairs of a bucket are verified on their full sets, not all of them: first each document with the smallest one it meets,
then with the smallest of each of its buckets as far as they are not connected yet, and at last all pairs of different
components that share a bucket, in blocks of bounded size that give connected parts and no pairs. Pairs that are connected
already need no test: a link between them changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import WordHashes, mixed, row_map, shingles
from maskwright.llm.components import components
from maskwright.session import written

BANDS, ROWS = 32, 4
PERCENT = 75
AT_ONCE = 2048
PARTNERS = 64
TOGETHER = 512


def _permuted(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit numbers (the finaliser of murmur3); changes x."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(found: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of a non-empty set of 64-bit hashes: coordinate k is the least of permutation(place + k)."""
    places = (mixed(found) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    least = np.full(size, np.uint32(0xFFFFFFFF))
    for at in range(0, len(places), AT_ONCE):
        part = _permuted(places[None, at : at + AT_ONCE] + shifts)
        np.minimum(least, part.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit bucket per band, different for different bands."""
    keys = np.arange(bands, dtype=np.uint64)
    for row in least.reshape(bands, rows).T:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    return keys.view(np.int64)


def sketch(docs: DataFrame, text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Replaces the text by `n_shingles`, `digest` (of the whole set, NULL if empty) and `buckets`."""

    def make():
        import xxhash

        hashes = WordHashes()

        def one(value):
            found = shingles(value, hashes)
            if not len(found):
                return 0, None, []
            keys = band_keys(signature(found, bands * rows), bands, rows)
            return len(found), xxhash.xxh3_128_digest(found.tobytes()), keys

        return one

    return row_map(docs, text, "n_shingles long, digest binary, buckets array<long>", make)


def verified(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity. texts: `doc_id` and `text`.

    The text of an `a` with many partners is sent once for every PARTNERS of them.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("shares"))
    dealt = pairs.join(many, "a").withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int"))
    left = dealt.select("a", "share").distinct().join(texts, F.col("a") == F.col("doc_id"))
    right = dealt.join(texts, F.col("b") == F.col("doc_id"))
    rows = left.select("a", "share", F.lit(None).cast("long").alias("b"), "text").unionByName(
        right.select("a", "share", "b", "text")
    )
    together = rows.repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, own = WordHashes(), np.zeros(0, np.uint64)
        for batch in batches:
            first, second = [], []
            for a, b, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                found = shingles(text.as_py(), hashes)
                if not b.is_valid:
                    own = found
                    continue
                small, large = sorted((len(own), len(found)))
                if 100 * small >= percent * large:
                    common = len(np.intersect1d(own, found, assume_unique=True))
                    if 100 * common >= percent * (len(own) + len(found) - common):
                        first.append(a.as_py())
                        second.append(b.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=["a", "b"])

    return together.select("a", "b", "text").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """`doc_id`, `n_shingles`, `component_id` and `kept` (doc_id = component_id) for every row of `doc_id` and text.

    Texts without words have no shingles and are linked with nothing. doc_id should name one text; rows that repeat it
    with the same text get the same result each. Rows with a NULL doc_id are linked with nothing and kept, with a NULL
    component. An empty table gives an empty one. Other columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"))
    sketched = written(sketch(source), "sketches")
    known = sketched.filter("doc_id is not null and digest is not null")
    classes = written(known.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    reps = known.join(classes, (known.doc_id == classes.rep) & (known.digest == classes.digest), "left_semi")
    spread = reps.select("doc_id", F.posexplode("buckets").alias("band", "bucket")).distinct()
    firsts = spread.groupBy("bucket").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    members = written(spread.join(firsts.select("bucket", "first"), "bucket"), "buckets")
    met = reps.join(members.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "buckets")
    texts = written(source.join(met.dropDuplicates(["doc_id"]), "doc_id").dropDuplicates(["doc_id"]), "texts")

    pairs = members.filter("first < doc_id").groupBy("doc_id").agg(F.min("first").alias("a"))
    pairs = written(pairs.withColumnRenamed("doc_id", "b"), "pairs")
    links = written(verified(pairs, texts, percent), "verified")
    roots = written(components(links), "roots")
    more = written(_star_pairs(members, roots).join(pairs, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(written(verified(more, texts, percent), "verified"))
    roots = written(components(links), "roots")
    links = links.unionByName(written(_open_links(members, roots, texts, percent), "verified"))
    roots = written(components(links), "roots")
    named = classes.join(roots, F.col("rep") == F.col("node"), "left").select(
        "digest", F.coalesce("root", "rep").alias("component_id")
    )
    joined = sketched.join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    joined = members.join(roots, F.col("doc_id") == F.col("node"), "left")
    return joined.select("band", "bucket", "doc_id", "first", F.coalesce("root", "doc_id").alias("root"))


def _star_pairs(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Documents with the smallest one of each bucket, unless they are connected."""
    rooted = _rooted(members, roots)
    firsts = roots.select(F.col("node").alias("first"), F.col("root").alias("first_root"))
    joined = rooted.join(firsts, "first", "left").filter("root <> coalesce(first_root, first)")
    return joined.select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()


def _open_links(members: DataFrame, roots: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between documents of different components that meet in a bucket; b stands for all of a's part.

    Documents meet under the smallest document of their bucket, each once for all bands it shares with that one. A group
    with several components is dealt out in blocks of two shares; a block compares its pairs by bits, and gives a row for
    each document that has a link, not for each pair. A pair that meets under several documents is compared under the one
    of its first common band.
    """
    rooted = _rooted(members, roots)
    grouped = rooted.groupBy("first", "doc_id").agg(
        F.expr("bit_or(shiftleft(1L, band))").alias("mask"), F.min("root").alias("root")
    )
    sizes = grouped.groupBy("first").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    shares = sizes.filter("low < high").select("first", F.ceil(F.col("n") / TOGETHER).cast("int").alias("shares"))
    dealt = (
        grouped.join(shares, "first")
        .withColumn("share", F.pmod(F.xxhash64("doc_id"), F.col("shares")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        .withColumn("i", F.least("share", "other"))
        .withColumn("j", F.greatest("share", "other"))
    )
    rows = dealt.join(texts, "doc_id").select("first", "i", "j", "doc_id", "share", "root", "mask", "buckets", "text")
    return rows.groupBy("first", "i", "j").applyInArrow(_block(percent), "a long, b long")


def _block(percent: int):
    def run(table: pa.Table) -> pa.Table:
        hashes = WordHashes()
        ids, share, root, mask = (table.column(c).to_numpy() for c in ("doc_id", "share", "root", "mask"))
        buckets = np.stack([x.values.to_numpy() for x in table.column("buckets")])
        sets = [shingles(x.as_py(), hashes) for x in table.column("text")]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        bits = _shared_bits(sets)
        within = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        label = ids.copy()
        for x in range(len(ids) - 1):
            y = np.arange(x + 1, len(ids))
            small, large = np.minimum(sizes[x], sizes[y]), np.maximum(sizes[x], sizes[y])
            y = y[(root[y] != root[x]) & (100 * small >= percent * large) & (within | (share[y] != share[x]))]
            if not len(y):
                continue
            same = buckets[y] == buckets[x]
            first = same.argmax(axis=1)
            y = y[same.any(axis=1) & ((mask[y] & mask[x]) >> first & 1 == 1)]
            if not len(y):
                continue
            common = np.bitwise_count(bits[y] & bits[x]).sum(axis=1, dtype=np.int64)
            for other in y[100 * common >= percent * (sizes[x] + sizes[y] - common)]:
                low, high = sorted((label[x], label[other]))
                label[label == high] = low
        linked = label != ids
        return pa.table({"a": pa.array(ids[linked]), "b": pa.array(label[linked])})

    return run


def _shared_bits(sets: list[np.ndarray]) -> np.ndarray:
    """One row of bits per set, one bit per element that several of the sets have."""
    every = np.concatenate(sets)
    values, where, counts = np.unique(every, return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    width = (int((counts > 1).sum()) + 63) // 64 * 8
    bits = np.zeros((len(sets), width * 8), np.uint8) if len(sets) * width < 4_000_000 else None
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = counts[where] > 1
    rows, columns = rows[keep], column[where[keep]]
    if bits is not None:
        bits[rows, columns] = 1
        return np.packbits(bits, axis=1).view(np.uint64)
    packed = np.zeros((len(sets), width), np.uint8)
    np.bitwise_or.at(packed, (rows, columns >> 3), (1 << (columns & 7)).astype(np.uint8))
    return packed.view(np.uint64)
