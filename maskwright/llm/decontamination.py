"""Benchmark decontamination with a positional inverted index, kept document by document.

The postings of a document are the positions of every term that the benchmark uses, term after term. They are written
once. For the look-up those of a batch of documents are written back into word order, an array of terms by place. A benchmark
window is looked up from its rarest term over the whole corpus: at each place of that one, the next rarest are tested by their
offset, and so on; this gives the same places as lists moved and intersected. What is left are the places where the whole
window stands. Terms that occur near the rarest one give proximity matches.

The benchmark is worked through in blocks of bounded size; each block is looked up in all documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.session import written

WINDOW = 13
NEAR = 26
BLOCK_BYTES = 8_000_000
AT_ONCE = 1_000_000
_APART = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of characters beyond ASCII; A-Z in lower case."""
    return (text or "").encode("utf-8", "replace").translate(_APART).split()


@dataclass(frozen=True)
class Windows:
    """The distinct windows of a block of items: terms by offset, -1 behind the end of a short one."""

    vocabulary: dict[bytes, int]
    terms: np.ndarray
    sizes: np.ndarray
    items: list[list[str]]


def windows_of(items: list[tuple[object, str | None]], size: int = WINDOW) -> Windows:
    """Every run of `size` words of each item; an item with fewer words is one window. Rows without an id count as ''."""
    vocabulary: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[str]] = {}
    for item_id, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]
        for at in range(max(0, len(ids) - size) + 1 if ids else 0):
            owners.setdefault(tuple(ids[at : at + size]), set()).add("" if item_id is None else str(item_id))
    terms = np.full((len(owners), size), -1, np.int32)
    for i, window in enumerate(owners):
        terms[i, : len(window)] = window
    sizes = np.array([len(w) for w in owners], np.int32)
    return Windows(vocabulary, terms, sizes, [sorted(x) for x in owners.values()])


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], keep: list[str], text: str = "text") -> DataFrame:
    """The `keep` columns of each row with `n_words` and its postings of known terms: `terms`, `counts`, `positions`."""
    kept = [docs.schema[c] for c in keep]
    schema = T.StructType(
        [
            *kept,
            T.StructField("n_words", T.LongType()),
            T.StructField("terms", T.ArrayType(T.IntegerType())),
            T.StructField("counts", T.ArrayType(T.IntegerType())),
            T.StructField("positions", T.ArrayType(T.IntegerType())),
        ]
    )
    lists = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500)
                sizes, postings = [], []
                for value in part.column(len(keep)):
                    found = words(value.as_py())
                    ids = np.fromiter((get(w, -1) for w in found), np.int32, len(found))
                    places = np.flatnonzero(ids >= 0).astype(np.int32)
                    order = np.argsort(ids[places], kind="stable")
                    terms, counts = np.unique(ids[places], return_counts=True)
                    sizes.append(len(found))
                    postings.append((terms.astype(np.int32), counts.astype(np.int32), places[order]))
                arrays = [pa.array([p[i] for p in postings], lists) for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(sizes, pa.int64()), *arrays], names=schema.names
                )

    return docs.select(*keep, F.col(text).alias("__in")).mapInArrow(run, schema)


def term_counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """How often each term occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            terms = batch.column(0).flatten().to_numpy()
            np.add.at(total, terms, batch.column(1).flatten().to_numpy())
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], names=["term", "n"])

    sums = index.select("terms", "counts").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    total = np.zeros(n_terms, np.int64)
    for term, n in sums.collect():  # one row per term of a block of the benchmark
        total[term] = n
    return total


class Lookup:
    """Windows filed under their rarest term, with the order in which their terms are tested."""

    def __init__(self, windows: Windows, frequency: np.ndarray):
        n, size = windows.terms.shape
        self.windows = windows
        rank = np.where(windows.terms >= 0, frequency[windows.terms], np.iinfo(np.int64).max)
        self.offsets = np.argsort(rank, axis=1, kind="stable").astype(np.int32)
        self.wanted = np.take_along_axis(windows.terms, self.offsets, axis=1)
        first = self.wanted[:, 0] if n else np.zeros(0, np.int32)
        self.filed = np.argsort(first, kind="stable")
        bounds = np.arange(len(windows.vocabulary) + 1)
        self.begin = np.searchsorted(first[self.filed], bounds)

    def candidates(self, spoken: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of rarest terms with each of their windows, so many at once. spoken: term by place, -1 for others."""
        places = np.flatnonzero(spoken >= 0)
        begin = self.begin[spoken[places]]
        many = self.begin[spoken[places] + 1] - begin
        places, begin, many = places[many > 0], begin[many > 0], many[many > 0]
        ends = np.cumsum(many)
        at = 0
        while at < len(places):
            done = ends[at - 1] if at else 0
            until = max(at + 1, int(np.searchsorted(ends, done + AT_ONCE)))
            m = many[at:until]
            inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            yield np.repeat(places[at:until], m), self.filed[np.repeat(begin[at:until], m) + inner]
            at = until

    def phrases(self, spoken: np.ndarray, places: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and windows that stand there word for word: terms are tested by offset, one after another."""
        starts = places - self.offsets[which, 0]
        for k in range(1, self.wanted.shape[1]):
            wanted = self.wanted[which, k]
            stands = (wanted < 0) | (spoken[starts + self.offsets[which, k]] == wanted)
            starts, which = starts[stands], which[stands]
        return starts, which

    def near(self, spoken: np.ndarray, places: np.ndarray, which: np.ndarray, reach: int) -> np.ndarray:
        """Which pairs have the window's second and third rarest term within `reach` words of the rarest one."""
        size = len(spoken)
        filed = np.flatnonzero(spoken >= 0)
        keys = np.sort(spoken[filed].astype(np.int64) * size + filed)
        good = np.ones(len(places), bool)
        for k in range(1, min(3, self.wanted.shape[1])):
            wanted = self.wanted[which, k].astype(np.int64)
            low = np.searchsorted(keys, wanted * size + np.maximum(places - reach, 0))
            high = np.searchsorted(keys, wanted * size + np.minimum(places + reach, size - 1), side="right")
            good &= (wanted < 0) | (high > low)
        return good


def _found(index: DataFrame, lookup: Lookup, keep: list[str], near: int) -> DataFrame:
    """The runs of words inside windows, the items found, and the items found nearby, row by row of the index."""
    schema = T.StructType(
        [
            *[index.schema[c] for c in keep],
            T.StructField("n_words", T.LongType()),
            T.StructField("begins", T.ArrayType(T.LongType())),
            T.StructField("ends", T.ArrayType(T.LongType())),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("near_items", T.ArrayType(T.StringType())),
        ]
    )
    numbers, strings = pa.list_(pa.int64()), pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                part = whole.slice(at, 200)
                made = _batch(part, len(keep), lookup, near)
                arrays = [pa.array(x, t) for x, t in zip(made, (numbers, numbers, strings, strings), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep) + 1], *arrays], names=schema.names)

    return index.select(*keep, "n_words", "terms", "counts", "positions").mapInArrow(run, schema)


def _batch(part: pa.RecordBatch, at: int, lookup: Lookup, near: int) -> tuple[list, list, list, list]:
    n_words = part.column(at).to_numpy()
    size = lookup.windows.terms.shape[1]
    gap = size + near  # between documents, so that nothing reaches from one into the next
    base = gap + np.concatenate([[0], np.cumsum(n_words + gap)[:-1]]).astype(np.int64)
    spoken = np.full(int(base[-1] + n_words[-1] + gap) if len(base) else 0, -1, np.int32)
    for i in range(part.num_rows):
        terms, counts, positions = (part.column(at + k)[i].values for k in (1, 2, 3))
        if len(terms):
            spoken[base[i] + positions.to_numpy()] = np.repeat(terms.to_numpy(), counts.to_numpy())
    change = np.zeros(len(spoken) + 1, np.int32)
    items: list[set[str]] = [set() for _ in base]
    nearby: list[set[str]] = [set() for _ in base]
    for places, which in lookup.candidates(spoken):
        starts, exact = lookup.phrases(spoken, places, which)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + lookup.windows.sizes[exact], -1)
        _note(items, base, starts, exact, lookup)
        if near:
            good = lookup.near(spoken, places, which, near)
            _note(nearby, base, places[good], which[good], lookup)
    hit = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    begins, ends = edges[::2], edges[1::2]
    cut = np.searchsorted(begins, np.append(base, len(spoken)))
    runs = [(begins[cut[i] : cut[i + 1]] - base[i], ends[cut[i] : cut[i + 1]] - base[i]) for i in range(len(base))]
    return [r[0] for r in runs], [r[1] for r in runs], [sorted(x) for x in items], [sorted(x) for x in nearby]


def _note(into: list[set[str]], base: np.ndarray, places: np.ndarray, which: np.ndarray, lookup: Lookup) -> None:
    if len(places):
        docs = np.searchsorted(base, places, side="right") - 1
        for pair in np.unique(docs * len(lookup.windows.sizes) + which):
            doc, window = divmod(int(pair), len(lookup.windows.sizes))
            into[doc].update(lookup.windows.items[window])


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    text: str = "text",
    size: int = WINDOW,
    near: int = NEAR,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: the `keep` columns, `n_words`, `n_hit` (words inside an occurrence of a window), `items`
    (ids, as sorted strings, of items with an occurring window) and `near_items` (those with the second and third
    rarest term of a window within `near` words of the rarest).

    benchmark: `item_id` and `text`. A document without text has no words and no hits; so has every document if the
    benchmark is empty. Items without words have no windows; equal items are all named; repeated documents stay. The
    names of `keep` must not clash with the results.
    """
    spark = docs.sparkSession
    lengths = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-lengths // block_bytes))
    asked = benchmark.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block"))
    source = docs.select(*keep, text)
    if blocks > 1:  # rows need a name of their own to be brought together again
        source = written(source.withColumn("__row", F.monotonically_increasing_id()), "numbered-documents")
    names = [*keep, "__row"] if blocks > 1 else keep
    found = None
    for block in range(blocks):
        items = [(r[0], r[1]) for r in asked.filter(F.col("block") == block).select("item_id", "text").collect()]
        windows = windows_of(items, size)
        index = written(build_index(source, windows.vocabulary, names, text), "postings")
        lookup = Lookup(windows, term_counts(index, len(windows.vocabulary)))
        part = _found(index, lookup, names, near)
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        runs = F.flatten(F.collect_list(F.arrays_zip("begins", "ends")))
        found = found.groupBy(*names).agg(
            F.first("n_words").alias("n_words"),
            runs.alias("runs"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
        )
        covered = (
            "aggregate(array_sort(runs), named_struct('n', 0L, 'at', 0L), (s, r) -> named_struct('n', s.n + "
            "greatest(0L, r.ends - greatest(s.at, r.begins)), 'at', greatest(s.at, r.ends)), s -> s.n)"
        )
        return found.select(*keep, "n_words", F.expr(covered).alias("n_hit"), "items", "near_items")
    n_hit = F.expr("aggregate(zip_with(ends, begins, (e, b) -> e - b), 0L, (s, x) -> s + x)")
    return found.select(*keep, "n_words", n_hit.alias("n_hit"), "items", "near_items")


CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def items_digest(items: list[str]) -> str:
    """SHA-256 of the item ids, sorted as strings and joined by commas; as the query writes it in SQL."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
