"""Removal of long byte strings that occur more than once, by content-defined phrases and their dictionary.

A trigger is a place whose rolling hash is the lowest among the first places of some window of the asked length. Equal
windows have their trigger at equal distance, so they lie in phrases around triggers with equal text. A phrase is all
windows of one trigger, with the text they cover; phrases overlap by what the windows reach, as prefix-free parsing has
it. The dictionary holds each distinct phrase once, filed under the text that follows its trigger.

A phrase that occurs twice is repeated as a whole. A phrase whose following text occurs nowhere else has no repeated
window. Only the rest is looked into: the windows of the distinct phrases under one text are counted by their fingerprints,
and those that occur twice are repeated. Where too many distinct phrases meet under one text, they are filed again under longer
stretches, until few are left or all are equal. Text is compared by 64-bit fingerprints of rolling hashes; two windows are only ever
taken for equal if the fingerprints of the text after the trigger agree as well.

Counting equal windows takes the place of the suffix array of the dictionary and that of the parse, of which there is none:
equal windows always meet under one text, and only equality to one length is asked, not the order of suffixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.common import MASK, mixed
from maskwright.operators.skew import hot_split_join
from maskwright.session import written

GRAM = 16
TOGETHER = 1000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int, of: int, known: dict = {}) -> np.ndarray:  # noqa: B006  shared within a worker on purpose
    held = known.get(of)
    if held is None or len(held) < n:
        size = max(n, 1 << 16, 0 if held is None else 2 * len(held))
        held = np.full(size, np.uint64(of))
        held[0] = 1
        known[of] = held = np.multiply.accumulate(held)
    return held[:n]


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | (x[step:] << np.uint64(8 * step))
    return x


class Fingerprints:
    """Fingerprints of any stretch of at least eight bytes of one text."""

    def __init__(self, data: bytes):
        self.eights = _eights(np.frombuffer(data, np.uint8))
        spread = mixed(self.eights)
        self.sums = np.zeros(len(spread) + 1, np.uint64)
        np.cumsum(spread * _powers(len(spread), _BASE), out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = _powers(int(begin.max()) + 1, _INVERSE)[begin] if len(begin) else np.zeros(0, np.uint64)
        return mixed((self.sums[end - 7] - self.sums[begin]) * back + (end - begin).astype(np.uint64))


def _least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours, in time that doesn't depend on the width."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.uint64(MASK))
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def phrases(data: bytes, length: int) -> tuple[np.ndarray, ...] | None:
    """Of each phrase: trigger, first and last window start, fingerprints of the text behind the trigger and of the whole.

    None for texts shorter than a window.
    """
    if len(data) < length:
        return None
    reach = _reach(length)
    prints = Fingerprints(data)
    grams = mixed(prints.eights[: -(GRAM - 8)] + mixed(prints.eights[GRAM - 8 :]))
    place_bits = max(1, int(len(data)).bit_length())
    # the hash in the upper bits decides, equal ones from left to right
    ordered = ((grams >> np.uint64(32)) << np.uint64(place_bits)) | np.arange(len(grams), dtype=np.uint64)
    starts = len(data) - length + 1
    least = _least_of(ordered[: starts + reach - 1], reach)
    trigger = (least & np.uint64((1 << place_bits) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], trigger[1:] != trigger[:-1]]))
    last = np.append(first[1:], starts) - 1
    trigger = trigger[first]
    behind = prints.of(trigger, trigger + length - reach + 1)
    shape = (trigger - first).astype(np.uint64) * np.uint64(length) + (last - first).astype(np.uint64)
    return trigger, first, last, behind, mixed(prints.of(first, last + length) + shape)


def _reach(length: int) -> int:
    """Among how many first places of a window its trigger is sought."""
    return 3 * length // 4


def _named(docs: DataFrame, text: str) -> DataFrame:
    """`k1`, `k2`: a name for each distinct row of doc_id and text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("__text", whole).withColumn("k1", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn(
        "k2", F.xxhash64(F.col("doc_id").isNull(), "__text")
    )


def _parse(named: DataFrame, length: int) -> DataFrame:
    names = ["k1", "k2", "at", "first", "last", "behind", "phrase"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, text in zip(*batch.columns, strict=True):
                found = phrases(text.as_py().encode("utf-8", "replace"), length)
                if found is None:
                    continue
                at, first, last, behind, phrase = found
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, k1.as_py(), np.int64)),
                        pa.array(np.full(n, k2.as_py(), np.int64)),
                        *[pa.array(x.astype(np.int32)) for x in (at, first, last)],
                        pa.array(behind.view(np.int64)),
                        pa.array(phrase.view(np.int64)),
                    ],
                    names=names,
                )

    schema = "k1 long, k2 long, at int, first int, last int, behind long, phrase long"
    return named.select("k1", "k2", "__text").mapInArrow(run, schema)


def _cut_out(wanted: DataFrame, named: DataFrame, length: int) -> DataFrame:
    """Dictionary entries with their bytes: `behind`, `single`, k1, k2, `first`, `lead` (trigger - first), `data`."""
    lists = wanted.groupBy("k1", "k2").agg(
        F.collect_list(F.struct("behind", "single", "first", "last", "at")).alias("wanted")
    )
    texts = named.select("k1", "k2", "__text").join(lists, ["k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, text, asked in zip(*batch.columns, strict=True):
                data = text.as_py().encode("utf-8", "replace")
                rows = asked.as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["behind"] for r in rows], pa.int64()),
                        pa.array([r["single"] for r in rows], pa.bool_()),
                        pa.array([k1.as_py()] * len(rows), pa.int64()),
                        pa.array([k2.as_py()] * len(rows), pa.int64()),
                        pa.array([r["first"] for r in rows], pa.int32()),
                        pa.array([r["at"] - r["first"] for r in rows], pa.int32()),
                        pa.array([data[r["first"] : r["last"] + length] for r in rows], pa.binary()),
                    ],
                    names=["behind", "single", "k1", "k2", "first", "lead", "data"],
                )

    return texts.select("k1", "k2", "__text", "wanted").mapInArrow(
        run, "behind long, single boolean, k1 long, k2 long, first int, lead int, data binary"
    )


def _window_prints(data: bytes, lead: int, lo: int, hi: int, length: int) -> tuple[int, np.ndarray]:
    """The first of a phrase's windows that begin `lo` to `hi` bytes before its trigger, and the fingerprints of these, each
    with its distance to the trigger."""
    begin = max(0, lead - hi)
    start = np.arange(begin, min(len(data) - length, lead - lo) + 1)
    return begin, mixed(Fingerprints(data).of(start, start + length) + (lead - start).astype(np.uint64))


_STARTS = "k1 long, k2 long, begin int, end int"


def _starts_batch(k1: list, k2: list, begin: list, end: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(begin, pa.int32()), pa.array(end, pa.int32())],
        names=["k1", "k2", "begin", "end"],
    )


def _repeated_among(entries: DataFrame, length: int) -> DataFrame:
    """Runs of repeated window starts in phrases that occur once, found among all phrases filed under one key."""
    together = entries.repartition("key").sortWithinPartitions("key")

    def group(rows: list[tuple]) -> pa.RecordBatch | None:
        if len(rows) < 2:
            return None
        found = [_window_prints(data, lead, lo, hi, length) for lo, hi, _, _, _, _, lead, data in rows]
        _, where, counts = np.unique(np.concatenate([p for _, p in found]), return_inverse=True, return_counts=True)
        repeated = counts[where] > 1
        made: tuple[list, list, list, list] = ([], [], [], [])
        at = 0
        for (_, _, single, k1, k2, first, _, _), (skipped, own) in zip(rows, found, strict=True):
            first += skipped
            part = repeated[at : at + len(own)]
            at += len(own)
            if single and part.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[0], part.astype(np.int8), [0]])))
                for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    for into, x in zip(made, (k1, k2, first + begin, first + end - 1), strict=True):
                        into.append(x)
        return _starts_batch(*made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        for batch in batches:
            for key, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != held:
                    if (made := group(rows)) is not None:
                        yield made
                    held, rows = key, []
                rows.append(tuple(row))
        if (made := group(rows)) is not None:
            yield made

    return together.select(*_FILED).mapInArrow(run, _STARTS)


_FILED = ["key", "lo", "hi", "single", "k1", "k2", "first", "lead", "data"]
_PLACE = ["k1", "k2", "first"]


def _halved(entries: DataFrame, length: int) -> DataFrame:
    """Each phrase under both halves of its range of distances, with `key`, the fingerprint of what all windows of a half cover,
    and `full`, that of all that the phrase's own windows of it cover, which lie from `low` to `high`."""
    schema = "key long, full long, low int, high int, lo int, hi int, single boolean, k1 long, k2 long, first int, lead int, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, lo, hi, single, k1, k2, first, lead, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                prints, middle = Fingerprints(data), (lo + hi) // 2
                for a, b in ((lo, middle), (middle + 1, hi)):
                    low, high = max(a, lead + length - len(data)), min(b, lead)
                    if a > b or low > high:
                        continue
                    at = np.array([[lead - a, lead + length - b], [lead - high, lead + length - low]], np.int64)
                    key, full = mixed(prints.of(at[:, 0], at[:, 1]) + np.array([a << 20 | b, low << 20 | high], np.uint64)).view(np.int64)
                    rows.append((int(key), int(full), low, high, a, b, single, k1, k2, first, lead, data))
            columns = zip(*rows, strict=True) if rows else [[]] * 12
            types = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.bool_()] + [pa.int64()] * 2 + [pa.int32()] * 2 + [pa.binary()]
            names = [f.split()[0] for f in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return entries.select(*_FILED).mapInArrow(run, schema)


def _repeated_of_hot(entries: DataFrame, length: int, together: int) -> DataFrame:
    """The same for keys with so many phrases that they can't meet in one task.

    Their windows are told apart by how far before the trigger they begin, and the range of these distances is halved: all
    windows of a half cover a longer stretch, which becomes the key. Phrases whose windows of a half are all equal have
    repeated windows there; one of them goes on for the rest. So a passage that many phrases share is done with as soon as a
    half lies in it, and only its two edges are halved further, down to one distance, where a key is a window.
    """
    starts = None
    while not entries.isEmpty():
        halves = written(_halved(entries, length), "halves")
        one = F.min(F.struct(*_PLACE)).alias("one")
        classes = written(halves.groupBy("key", "full").agg(F.count("*").alias("n"), one), "classes")
        sizes = classes.groupBy("key").agg(F.count("*").alias("m"))
        known = written(hot_split_join(halves, classes, ["key", "full"], _PLACE, "inner"), "halves-known")
        first = F.col("first") + F.col("lead")
        same = known.filter("n > 1 and single").select(
            "k1", "k2", (first - F.col("high")).alias("begin"), (first - F.col("low")).alias("end")
        )
        going = known.filter(F.struct(*_PLACE) == F.col("one")).withColumn("single", F.expr("single and n = 1"))
        going = written(hot_split_join(going.select(*_FILED), sizes.filter("m > 1"), ["key"], _PLACE, "inner"), "halves-going")
        found = same.unionByName(_repeated_among(going.filter(F.col("m") <= together), length))
        starts = found if starts is None else starts.unionByName(found)
        entries = going.filter(F.col("m") > together)
    return starts


def remove_repeats(
    docs: DataFrame, keep: list[str], text: str = "text", length: int = 400, together: int = TOGETHER
) -> DataFrame:
    """One row per document: the `keep` columns, `n_bytes`, `begins` and `ends` of the maximal removed runs of bytes, and
    `kept`, the remaining bytes. docs must have `doc_id`.

    A byte is removed if a string of `length` bytes over it also starts anywhere else, in the same or another row; all
    copies go, the first one too. NULL texts count as empty, texts shorter than `length` stay whole. Rows that repeat
    doc_id and text are copies of each other; NULL ids are allowed. An empty table gives an empty one. `keep` must not
    hold the names of the results.
    """
    named = _named(docs, text)
    parse = written(_parse(named, length), "parse")
    entries = parse.groupBy("behind", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "at")).alias("at"))
    entries = written(entries, "dictionary")
    filed = entries.groupBy("behind").agg(F.sum("n").alias("total"), F.count("*").alias("distinct")).filter("total > 1")
    repeated = written(
        parse.join(
            entries.join(filed, "behind").select("behind", "phrase", "n", "distinct", F.col("at").alias("chosen")),
            ["behind", "phrase"],
        ),
        "repeated-phrases",
    )
    whole = repeated.filter("n > 1").select("k1", "k2", F.col("first").alias("begin"), F.col("last").alias("end"))
    own = F.struct("k1", "k2", "at") == F.col("chosen")
    wanted = repeated.filter((F.col("distinct") > 1) & own).withColumn("single", F.col("n") == 1)

    def filed(some: DataFrame) -> DataFrame:
        """The phrases under the text behind their trigger, with all distances that windows may have to it."""
        cut = _cut_out(some, named, length).withColumnRenamed("behind", "key")
        return cut.withColumns({"lo": F.lit(0), "hi": F.lit(_reach(length) - 1)})

    hot = wanted.filter(F.col("distinct") > together)
    starts = whole.unionByName(_repeated_among(filed(wanted.filter(F.col("distinct") <= together)), length))
    if not hot.isEmpty():
        starts = starts.unionByName(_repeated_of_hot(written(filed(hot), "hot-phrases"), length, together))
    lists = starts.groupBy("k1", "k2").agg(F.collect_set(F.struct("begin", "end")).alias("starts"))
    joined = named.select(*keep, "k1", "k2", "__text").join(lists, ["k1", "k2"], "left").select(*keep, "__text", "starts")
    return _removed(joined, keep, length)


def _removed(joined: DataFrame, keep: list[str], length: int) -> DataFrame:
    numbers = pa.list_(pa.int64())
    schema = T.StructType(
        [
            *[joined.schema[c] for c in keep],
            T.StructField("n_bytes", T.LongType()),
            T.StructField("begins", T.ArrayType(T.LongType())),
            T.StructField("ends", T.ArrayType(T.LongType())),
            T.StructField("kept", T.BinaryType()),
        ]
    )

    def one(text: str, starts: list | None) -> tuple[int, list[int], list[int], bytes]:
        data = text.encode("utf-8", "replace")
        begins: list[int] = []
        ends: list[int] = []
        for s in sorted((s["begin"], s["end"]) for s in starts or []):
            if begins and s[0] <= ends[-1]:
                ends[-1] = max(ends[-1], s[1] + length)
            else:
                begins.append(s[0])
                ends.append(s[1] + length)
        kept = b"".join(data[a:b] for a, b in zip([0, *ends], [*begins, len(data)], strict=True))
        return len(data), begins, ends, kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                part = whole.slice(at, 64)
                rows = [one(t.as_py(), s.as_py()) for t, s in zip(part.column(len(keep)), part.column(len(keep) + 1), strict=True)]
                made = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), numbers, numbers, pa.binary()))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], names=schema.names)

    return joined.mapInArrow(run, schema)
