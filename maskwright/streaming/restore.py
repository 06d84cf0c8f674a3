"""Restoring texts that arrive in ordered chunks.

A placeholder may be cut anywhere. A chunk's end that could be the beginning of a placeholder is held back until
the next chunk, so that every piece that leaves has only whole placeholders and is restored like any text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import TimerValues

from maskwright.fixed_values import PLACEHOLDER_PATTERN
from maskwright.operators.masking import restore
from maskwright.operators.skew import broadcast_if_small, null_safe_join, running_total
from maskwright.session import ROCKSDB, scratch_scope, written

_OPEN_TAIL = re.compile(r"\[[A-Z0-9_]*\Z")
_PLACEHOLDER = re.compile(PLACEHOLDER_PATTERN)
TTL_MS = 600_000
KEEP_MS = 24 * 3600 * 1000
MAX_BROADCAST_CROSSINGS = 100_000
PIECES = "session_id string, seq bigint, piece string"


def split_held(text: str, longest: int | None = None) -> tuple[str, str]:
    """Text that may leave, and the end held back: an unclosed placeholder, shorter than the longest if that is known."""
    tail = _OPEN_TAIL.search(text)
    if tail is None or (longest is not None and len(tail.group()) >= longest):
        return text, ""
    return text[: tail.start()], tail.group()


def _text(data: object) -> str:
    """A chunk without data, as one that only ends its session, holds nothing."""
    return data if isinstance(data, str) else ""


def _chunk_rows(batch: pd.DataFrame) -> Iterator[tuple]:
    """Number, text and end mark of each chunk; a missing mark (NULL, or NaN in pandas) is no end."""
    eof = (e == e and bool(e) for e in batch["eof"].tolist())
    return zip(batch["seq"].tolist(), map(_text, batch["data"].tolist()), eof, strict=True)


class WholePlaceholders(StatefulProcessor):
    """Per session: the next chunk number, the text held back, chunks that came too early, and the numbers given up on.

    The place stays when a session ends or falls silent, so that a chunk that is sent again is known, one that comes late
    leaves at once, and one that goes on goes on. With `keep_ms` the state of a session that is not heard of goes by itself.
    """

    def __init__(self, longest: int | None, ttl_ms: int | None, keep_ms: int | None = None):
        self.longest = longest
        self.ttl_ms = ttl_ms
        self.keep_ms = None if ttl_ms is None else keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next bigint, held string, expires bigint", self.keep_ms)
        self.early = handle.getMapState("early", "seq bigint", "data string, eof boolean", self.keep_ms)
        self.missing = handle.getMapState("missing", "seq bigint", "open boolean", self.keep_ms)

    def whole(self, text: str) -> str:
        """What leaves for a text that holds only whole placeholders."""
        return text

    def handleInputRows(  # noqa: N802
        self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues  # noqa: N803
    ) -> Iterator[pd.DataFrame]:
        # Every question to the state is a round trip. A session without a place has nothing else in it either.
        place = self.place.get()
        at, held, expires = place or (0, "", 0)
        self.used = place is not None
        out, ended = [], False

        def take(data: str, eof: bool) -> None:
            nonlocal at, held, ended
            ready, held = (held + data, "") if eof else split_held(held + data, self.longest)
            out.append((key[0], at, self.whole(ready)))
            at, ended = at + 1, eof

        for batch in rows:
            for seq, data, eof in sorted(_chunk_rows(batch)):
                if seq == at:
                    take(data, eof)
                elif seq > at:
                    self.early.updateValue((int(seq),), (data, eof))
                    self.used = True
                elif self.used and self.missing.containsKey((int(seq),)):
                    self.missing.removeKey((int(seq),))
                    out.append((key[0], int(seq), self.whole(data)))
            while self.used and (waiting := self.early.getValue((at,))) is not None:
                self.early.removeKey((at,))
                take(*waiting)
            if out:
                yield self._rows(out)
                out.clear()
        self._keep(at, held, expires, timerValues, ended and not held)

    @staticmethod
    def _rows(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["session_id", "seq", "piece"])

    def _keep(self, at: int, held: str, expires: int, timerValues: TimerValues, quiet: bool) -> None:
        """The place, with a timer unless nothing can come of one."""
        if self.ttl_ms is None:
            self.place.update((at, held, 0))
            return
        if expires:
            self.handle.deleteTimer(expires)
        soon = 0
        if not quiet or (self.used and next(iter(self.early.keys()), None) is not None):
            soon = timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms
            self.handle.registerTimer(soon)
        self.place.update((at, held, soon))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """A session that fell silent gives up what it holds and waits for: early chunks leave in their order, each under its
        own number, and the numbers between them are written down as missing."""
        at, held, _ = self.place.get() if self.place.exists() else (0, "", 0)
        out = []
        for seq, (data, eof) in sorted((k[0], v) for k, v in self.early.iterator()):
            if seq > at:
                if held:
                    out.append((key[0], at, self.whole(held)))
                for number in range(at, seq):
                    self.missing.updateValue((number,), (True,))
                held = ""
            ready, held = (held + data, "") if eof else split_held(held + data, self.longest)
            out.append((key[0], seq, self.whole(ready)))
            at = seq + 1
        if held:
            out.append((key[0], at, self.whole(held)))
        self.early.clear()
        self.place.update((at, "", 0))
        yield self._rows(out)

    def close(self) -> None:
        pass


class RestoredSessions(WholePlaceholders):
    """The same with the mappings of each session in its state, where they are looked up when a text leaves.

    They come as the initial state, or among the input rows as `placeholder` and `original`; those of a batch count for
    all of its chunks.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.known = handle.getMapState("known", "placeholder string", "original string", self.keep_ms)
        # What this session was told in this batch, which need not be asked of the state again.
        self.told: tuple[tuple | None, dict[str, str]] = (None, {})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues: TimerValues) -> None:  # noqa: N802, N803
        self.told = (key, {})
        for placeholder, original in zip(initialState["placeholder"], initialState["original"], strict=True):
            self._learn(placeholder, original)

    def _learn(self, placeholder: object, original: object) -> None:
        if isinstance(placeholder, str) and isinstance(original, str):
            self.known.updateValue((placeholder,), (original,))
            self.told[1][placeholder] = original

    def _original(self, hit: re.Match) -> str:
        told = self.told[1].get(hit.group())
        if told is not None:
            return told
        found = self.known.getValue((hit.group(),))
        return hit.group() if found is None else found[0]

    def whole(self, text: str) -> str:
        return _PLACEHOLDER.sub(self._original, text) if "[" in text else text

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # Mappings may stand behind the chunks of their batch, so chunks wait in the state until all rows were seen.
        mixed, at = False, None
        if self.told[0] != key:
            self.told = (key, {})

        def chunks() -> Iterator[pd.DataFrame]:
            nonlocal mixed, at
            for batch in rows:
                if "placeholder" not in batch:
                    yield batch
                    continue
                mixed = True
                if at is None:
                    place = self.place.get()
                    at = place[0] if place is not None else 0
                named = batch["placeholder"].notna()
                for placeholder, original in zip(batch["placeholder"][named], batch["original"][named], strict=True):
                    self._learn(placeholder, original)
                late = batch[~named & (batch["seq"] < at)]
                waiting.append(late[["seq", "data", "eof"]])
                ahead = batch[~named & (batch["seq"] >= at)]
                for seq, data, eof in _chunk_rows(ahead):
                    self.early.updateValue((int(seq),), (data, eof))
                    self.used = True
            if mixed:
                yield pd.concat(waiting)

        waiting: list[pd.DataFrame] = []
        yield from super().handleInputRows(key, chunks(), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.told = (key, {})
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)


def _sessions(chunks: DataFrame, ttl_ms: int | None, processor: StatefulProcessor, known: DataFrame | None = None) -> DataFrame:
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return chunks.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=PIECES,
        outputMode="append",
        timeMode="none" if ttl_ms is None else "processingtime",
        initialState=None if known is None else known.groupBy("session_id"),
    )


def whole_placeholders(
    chunks: DataFrame, longest: int | None = None, ttl_ms: int | None = TTL_MS, keep_ms: int = KEEP_MS
) -> DataFrame:
    """Stream of pieces without cut placeholders, from a stream of (session_id, seq, data, eof).

    What is held back has the shape of a placeholder's beginning; `longest` bounds it where the names are known. A
    session that stays silent for `ttl_ms` is flushed; with None it waits for its last chunk. Its place is kept for `keep_ms`.
    """
    return _sessions(chunks, ttl_ms, WholePlaceholders(longest, ttl_ms, keep_ms))


def restored_sessions(
    chunks: DataFrame, mappings: DataFrame, ttl_ms: int | None = TTL_MS, keep_ms: int = KEEP_MS
) -> DataFrame:
    """Stream of restored pieces (session_id, seq, piece). `mappings` is a table, read once when the stream first starts, or a
    stream, whose rows count from their batch on, for `keep_ms` after they came."""
    processor = RestoredSessions(None, ttl_ms, keep_ms)
    named = mappings.select(F.col("session_id").cast("string"), "placeholder", "original")
    if not mappings.isStreaming:
        return _sessions(chunks, ttl_ms, processor, named)
    both = chunks.select("session_id", "seq", "data", "eof").unionByName(named, allowMissingColumns=True)
    return _sessions(both, ttl_ms, processor)


def longest_placeholder(mappings: DataFrame) -> int:
    return mappings.agg(F.max(F.char_length("placeholder"))).first()[0] or 0


def restore_pieces(pieces: DataFrame, mappings: DataFrame) -> DataFrame:
    """Originals back into pieces that hold only whole placeholders: session_id, seq, data."""
    keyed = pieces.withColumn("__key", F.concat_ws("/", "session_id", F.col("seq").cast("string")))
    done = restore(keyed, mappings, "__key", "session_id", "piece", into="data")
    return done.select("session_id", "seq", "data")


def restore_stream(
    chunks: DataFrame,
    mappings: DataFrame | Callable[[], DataFrame],
    output: str,
    checkpoint: str,
    ttl_ms: int | None = TTL_MS,
    available_now: bool = False,
) -> StreamingQuery:
    """Restore a stream of chunks and append (session_id, seq, data) to a Parquet folder.

    `mappings` may be a table, which becomes the state of the sessions once, when the stream first starts; a stream, whose
    rows go to the state of their session and count from their batch on; or a function that opens a table, which is read
    and joined for every batch. A run over what is available now sets no timers, which would keep it from ending; open
    sessions wait for the next. Rows of one number are in order of their batch: text that was held back at a silence, then
    a chunk that came after it.
    """
    ttl_ms = None if available_now else ttl_ms
    joined = callable(mappings)
    pieces = whole_placeholders(chunks, ttl_ms=ttl_ms) if joined else restored_sessions(chunks, mappings, ttl_ms)

    def write(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            # The stateful step runs once; everything after it reads what it left.
            restored = (
                restore_pieces(written(batch, "pieces"), mappings()) if joined else batch.withColumnRenamed("piece", "data")
            )
            # One folder per batch: a batch that is run again replaces what it wrote before.
            restored.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    writer = pieces.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _blocks_of_text(chunks: DataFrame, size: int) -> DataFrame:
    """Chunks joined to blocks of about `size` characters: session_id, block, text, and the block that follows.

    A block is named after the offset its first chunk starts at, so the next block is named by where this one ends.
    """
    filled = chunks.filter(F.char_length("data") > 0)
    offset = running_total(filled, ["session_id"], ["seq"], 1024, F.char_length("data"), "offset")
    in_order = F.expr("transform(array_sort(collect_list(struct(seq, data))), c -> c.data)")
    texts = (
        offset.withColumn("block", F.floor(F.col("offset") / size))
        .groupBy("session_id", "block")
        .agg(F.min("offset").alias("start"), F.array_join(in_order, "").alias("text"))
    )
    # The last block may end in the range it starts in; nothing has the number after it.
    after = F.greatest(F.floor((F.col("start") + F.char_length("text")) / size), F.col("block") + 1)
    return texts.select("session_id", "block", "text", after.alias("next"))


def restore_chunks(chunks: DataFrame, mappings: DataFrame, size: int = 4096) -> DataFrame:
    """The same for a finished table of chunks: (session_id, block, data), in order the restored text.

    A session of any length is worked on in blocks of text. A block owns the placeholders that begin in it: it
    borrows the end of its last one from what follows, and leaves out what the block before it has finished.
    Only block edges are exchanged, by joins on session and block. A block that is shorter than a placeholder
    has longer ones around it, so edges are passed on once.
    """
    longest = max(longest_placeholder(mappings), 1)
    texts = written(_blocks_of_text(chunks, max(size, 2 * longest)), "blocks")
    # Whether a placeholder crosses an edge is decided on the edges alone; the texts are not moved for it.
    trims, small = broadcast_if_small(written(_crossings(texts, longest), "crossings"), MAX_BROADCAST_CROSSINGS)
    pieces = null_safe_join(texts, trims, ["session_id", "block"]).select(
        "session_id",
        F.col("block").alias("seq"),
        F.concat(
            F.substr("text", F.coalesce("skip", F.lit(0)) + 1), F.coalesce("borrowed", F.lit(""))
        ).alias("piece"),
    )
    return restore_pieces(pieces if small else written(pieces, "pieces"), mappings).withColumnRenamed("seq", "block")


def _crossings(texts: DataFrame, longest: int) -> DataFrame:
    """For blocks at whose edges a placeholder crosses: how much to `skip` at the beginning, what is `borrowed` at the end."""
    edges = written(
        texts.select(
            "session_id", "block", "next", F.left("text", F.lit(longest)).alias("head"), F.right("text", F.lit(longest)).alias("tail")
        ),
        "edges",
    )
    empty = F.lit("")
    following = edges.select("session_id", F.col("block").alias("next"), F.col("head").alias("next_head"))
    previous = edges.select("session_id", F.col("next").alias("block"), F.col("tail").alias("previous_tail"))
    both = null_safe_join(null_safe_join(edges, following, ["session_id", "next"]), previous, ["session_id", "block"])
    # Both sides of an edge see the same characters, as many as a placeholder can have.
    around = written(
        both.select(
            "session_id",
            "block",
            "next",
            "tail",
            F.left(F.concat("head", F.coalesce("next_head", empty)), F.lit(longest)).alias("begins"),
            F.right(F.concat(F.coalesce("previous_tail", empty), "tail"), F.lit(longest)).alias("ends"),
        ),
        "around",
    )
    after = around.select("session_id", F.col("block").alias("next"), F.col("begins").alias("after"))
    before = around.select("session_id", F.col("next").alias("block"), F.col("ends").alias("before"))
    joined = null_safe_join(null_safe_join(around, after, ["session_id", "next"]), before, ["session_id", "block"])
    joined = joined.na.fill({"after": "", "before": ""})
    open_tail, closing = r"\[[A-Z0-9_]*\z", r"^[A-Z0-9_]*\]"
    whole = F.lit(f"^{PLACEHOLDER_PATTERN}\\z")
    begun, ending = F.regexp_extract("before", open_tail, 0), F.regexp_extract("begins", closing, 0)
    last, finish = F.regexp_extract("tail", open_tail, 0), F.regexp_extract("after", closing, 0)
    skip = F.when(F.regexp_like(F.concat(begun, ending), whole), F.char_length(ending)).otherwise(0)
    borrowed = F.when(F.regexp_like(F.concat(last, finish), whole), finish).otherwise(empty)
    return joined.select("session_id", "block", skip.alias("skip"), borrowed.alias("borrowed")).filter("skip > 0 or borrowed <> ''")
