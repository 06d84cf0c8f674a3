"""Sub-word pieces: words are cut in one pass by a trie that every worker holds, or by joins with a very large vocabulary."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from maskwright import fixed_values as fixed
from maskwright.functions.arrays import empty
from maskwright.functions.patterns import WORDS
from maskwright.functions.wordtrie import WordCutter
from maskwright.operators.skew import hot_split_join
from maskwright.session import written

MAX_BROADCAST_PIECES = 500_000


def special_ids(vocab: DataFrame) -> dict[str, int]:
    """Ids of the pieces for unknown words, start and end; all three must be in the vocabulary."""
    needed = [fixed.UNKNOWN_PIECE, fixed.START_PIECE, fixed.END_PIECE]
    found = {r["piece"]: r["id"] for r in vocab.filter(F.col("piece").isin(needed)).collect()}
    for piece in needed:
        if piece not in found:
            raise ValueError(f"the vocabulary is missing {piece}")
    return found


_CUTTERS: dict[str, WordCutter] = {}


def _cutter(vocab: DataFrame, unknown: int, max_length: int | None) -> Callable[[], WordCutter] | None:
    """What gives each worker its trie, made once from a broadcast vocabulary; None if that has too many pieces."""
    pieces = vocab.groupBy("piece").agg(F.max("id").alias("id")).filter("piece is not null").limit(MAX_BROADCAST_PIECES + 1).collect()
    if len(pieces) > MAX_BROADCAST_PIECES:
        return None
    shared = vocab.sparkSession.sparkContext.broadcast({r["piece"]: r["id"] for r in pieces})
    name = uuid.uuid4().hex

    def get() -> WordCutter:
        if name not in _CUTTERS:
            _CUTTERS.clear()
            _CUTTERS[name] = WordCutter(shared.value, unknown, max_length)
        return _CUTTERS[name]

    return get


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An array of lists of so many values each."""
    ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def wordpiece(
    words: DataFrame, vocab: DataFrame, word: str = "word", lowercase: bool = True, max_length: int | None = None
) -> DataFrame:
    """One row per distinct word with `pieces`, the ids it is cut into.

    From the left the longest known piece is taken, "##" marking pieces inside the word; a word that cannot be
    cut to its end, or is longer than `max_length` if that is given, is one unknown piece. A word costs in proportion to its
    length, unless the vocabulary has more than `MAX_BROADCAST_PIECES` pieces and is joined instead.
    """
    cutter = _cutter(vocab, special_ids(vocab)[fixed.UNKNOWN_PIECE], max_length)
    if cutter is None:
        return _joined_pieces(words, vocab, word, lowercase, max_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = _lists(*cutter()([w or "" for w in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pieces], names=[word, "pieces"])

    form = F.lower(word) if lowercase else F.col(word)
    distinct = words.select(word).distinct()
    schema = StructType([*distinct.schema.fields, *StructType.fromDDL("pieces array<bigint>").fields])
    return distinct.select(word, form.alias("__form")).mapInArrow(run, schema)


def _joined_pieces(words: DataFrame, vocab: DataFrame, word: str, lowercase: bool, max_length: int | None) -> DataFrame:
    """The same by joins of all parts of words with the vocabulary."""
    unknown = special_ids(vocab)[fixed.UNKNOWN_PIECE]
    longest = vocab.agg(F.max(F.char_length("piece"))).first()[0]
    form = F.lower(word) if lowercase else F.col(word)
    distinct = written(words.select(word).distinct().withColumn("__form", form), "words")
    forms = distinct.select("__form").distinct().filter(F.char_length("__form") > 0)
    if max_length is not None:
        forms = forms.filter(F.char_length("__form") <= max_length)
    starts = forms.select("__form", F.explode(F.sequence(F.lit(0), F.char_length("__form") - 1)).alias("start"))
    sizes = F.expr(f"sequence(1, least(char_length(__form) - start, {longest}))")
    cuts = starts.select("__form", "start", F.explode(sizes).alias("size")).withColumn(
        "piece", F.expr("concat(if(start > 0, '##', ''), substr(__form, start + 1, size))")
    )
    known = vocab.select("piece", "id")
    hits = hot_split_join(written(cuts, "cuts"), known, ["piece"], ["__form", "start"], how="inner")
    best = hits.groupBy("__form", "start").agg(F.max(F.struct("size", "id")).alias("best"))
    # At most one entry per character of a word.
    by_word = best.groupBy("__form").agg(F.array_sort(F.collect_list(F.struct("start", "best"))).alias("steps"))
    walk = (
        f"aggregate(steps, named_struct('at', 0, 'ids', {empty('bigint')}), (acc, s) -> if(s.start = acc.at, "
        "named_struct('at', acc.at + s.best.size, 'ids', array_append(acc.ids, cast(s.best.id as bigint))), acc))"
    )
    cut = by_word.withColumn("__walk", F.expr(walk)).select(
        "__form",
        F.when(F.col("__walk.at") == F.char_length("__form"), F.col("__walk.ids")).alias("__ids"),
    )
    whole = F.array(F.lit(unknown).cast("bigint"))
    return (
        distinct.join(cut, "__form", "left")
        .select(word, F.coalesce("__ids", whole).alias("pieces"))
    )


def encode_corpus(
    docs: DataFrame, vocab: DataFrame, key: str = "doc_id", text: str = "text", lowercase: bool = True,
    max_sequence: int | None = None,
) -> DataFrame:
    """Model input per document: input_ids, attention_mask, token_type_ids, word_index.

    All words are covered; `max_sequence` cuts the sequence to so many places, the two marks included. No more words of
    a document can matter then than there are places for pieces, so only those are looked at. One row for each row of
    `docs`; NULL texts have no words. Nothing is shuffled, unless the vocabulary is too large to go to every worker.
    """
    ids = special_ids(vocab)
    places = 2**31 - 1 if max_sequence is None else max_sequence - 2
    cutter = _cutter(vocab, ids[fixed.UNKNOWN_PIECE], None)
    pieces = _pieces_in_order if cutter else _pieces_joined
    sequence = pieces(docs, vocab, key, text, lowercase, places, cutter)
    none = F.expr(empty("bigint"))

    def framed(start: int, middle: str, end: int):
        edge = lambda v: F.array(F.lit(v).cast("bigint"))
        return F.concat(edge(start), F.slice(F.coalesce(F.col(middle), none), 1, places), edge(end))

    return (
        sequence.withColumn("input_ids", framed(ids[fixed.START_PIECE], "__ids", ids[fixed.END_PIECE]))
        .withColumn("word_index", framed(-1, "__index", -1))
        .withColumn("attention_mask", F.expr("array_repeat(1L, size(input_ids))"))
        .withColumn("token_type_ids", F.expr("array_repeat(0L, size(input_ids))"))
        .drop("__ids", "__index")
    )


def _words_of(text: str, lowercase: bool, places: int):
    """The words of a text that may matter, as an array."""
    found = F.slice(F.regexp_extract_all(F.col(text), F.lit(WORDS), F.lit(0)), 1, places)
    return F.transform(found, F.lower) if lowercase else found


def _pieces_in_order(docs, vocab, key, text, lowercase, places, cutter) -> DataFrame:
    """`__ids` and `__index` for each row, by the trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                words = batch.column(1)
                n = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                # each distinct word of a batch is cut once
                coded = words.flatten().dictionary_encode()
                code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                flat, sizes = cutter()(coded.dictionary.to_pylist())
                begins = np.cumsum(sizes) - sizes
                many = sizes[code]
                shift = np.repeat(begins[code] - (np.cumsum(many) - many), many)
                ids = flat[shift + np.arange(len(shift))]
                first = np.cumsum(n) - n
                index = np.repeat(np.arange(len(code)) - np.repeat(first, n), many)
                totals = np.append(0, np.cumsum(many))
                per_row = totals[first + n] - totals[first]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), _lists(ids, per_row), _lists(index, per_row)], names=[key, "__ids", "__index"]
                )

    source = docs.select(key, _words_of(text, lowercase, places).alias("__words"))
    fields = StructType.fromDDL("__ids array<bigint>, __index array<bigint>").fields
    return source.mapInArrow(run, StructType([source.schema[key], *fields]))


def _pieces_joined(docs, vocab, key, text, lowercase, places, cutter) -> DataFrame:
    """The same by a join of every word, for a vocabulary of any size."""
    rows = written(docs.select(key, _words_of(text, lowercase, places).alias("words")).withColumn("__row", F.monotonically_increasing_id()), "rows")
    words = written(rows.select("__row", F.posexplode("words").alias("index", "word")), "words")
    cut = _joined_pieces(words, vocab, "word", False, None)
    long = hot_split_join(words, cut, ["word"], ["__row", "index"], how="inner")
    per_row = long.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("index", "pieces"))).alias("__w"))
    flat = F.flatten(F.expr("transform(__w, w -> w.pieces)"))
    index = F.flatten(F.expr("transform(__w, w -> transform(w.pieces, p -> cast(w.index as bigint)))"))
    cuts = per_row.select("__row", flat.alias("__ids"), index.alias("__index"))
    return rows.select(key, "__row").join(cuts, "__row", "left").drop("__row")
