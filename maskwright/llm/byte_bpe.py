"""Byte-level BPE: encoding with a rank queue kept in a hierarchical bitmap, and decoding.

Pairs that may be merged wait in one bucket per merge rank, as positions of a linked list of parts. Which buckets hold
something is one bit each in a bitmap of three levels; finding the first set bit on each level gives the lowest rank.
A position whose pair has changed since it was filed is stale and skipped. Every merge costs a few steps whatever the
length of the pre-token, so a pre-token of a megabyte costs in proportion to its length.

Short pre-tokens are merged together: the new ones of many texts stand behind each other in one linked list with
barriers between, and a bucket is taken as a whole, the leftmost place of each pre-token at a time. Pre-tokens don't
touch, so each sees its own lowest rank first, as if it were alone. Pairs are looked up by the ids of their parts.
What a worker remembers and what it handles at once is bounded by bytes.
"""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from maskwright.llm.common import _arrow_schema

BITS = 64
CACHE_BYTES = 64 << 20
ENTRY_BYTES = 200
SHORT = 48
TOGETHER = 1 << 20
SLICE_BYTES = 4 << 20


class Memo:
    """What was made of the last keys. Two tables take turns: a full one becomes the old one, which still answers, and what
    is asked for again moves to the new one. So common keys stay and memory is bounded, by about twice `limit` bytes."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.size, self.new, self.old = limit, 0, {}, {}

    def recall(self, key):
        """An old entry, moved to the new table, or None; ask `new` first."""
        known = self.old.get(key)
        if known is not None:
            self.keep(key, known, 2 * len(key))
        return known

    def keep(self, key, value, size: int) -> None:
        if self.size >= self.limit:
            self.old, self.new, self.size = self.new, {}, 0
        self.new[key] = value
        self.size += ENTRY_BYTES + size


class RankQueue:
    """Positions filed under ranks; the lowest rank first, within a rank the leftmost position."""

    def __init__(self, n_ranks: int):
        leaves = n_ranks // BITS + 1
        middles = leaves // BITS + 1
        self.leaf, self.middle, self.root = [0] * leaves, [0] * middles, 0
        self.buckets: list[list[int]] = [[] for _ in range(n_ranks)]

    def put(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if bucket:
            heappush(bucket, position)
            return
        bucket.append(position)
        i, j = rank >> 6, rank >> 12
        self.leaf[i] |= 1 << (rank & 63)
        self.middle[j] |= 1 << (i & 63)
        self.root |= 1 << j

    def put_all(self, rank: int, places: list[int]) -> None:
        """As `put`, for places that `take_all` is to give back."""
        bucket = self.buckets[rank]
        if not bucket:
            i, j = rank >> 6, rank >> 12
            self.leaf[i] |= 1 << (rank & 63)
            self.middle[j] |= 1 << (i & 63)
            self.root |= 1 << j
        bucket.extend(places)

    def take_all(self) -> tuple[int, list[int]]:
        """The next rank and all its places; the root must have a bit set."""
        x = self.root
        j = (x & -x).bit_length() - 1
        x = self.middle[j]
        i = (j << 6) + (x & -x).bit_length() - 1
        x = self.leaf[i]
        rank = (i << 6) + (x & -x).bit_length() - 1
        places, self.buckets[rank] = self.buckets[rank], []
        self.leaf[i] = x = x & (x - 1)
        if not x:
            self.middle[j] = x = self.middle[j] & (self.middle[j] - 1)
            if not x:
                self.root &= self.root - 1
        return rank, places

    def take(self) -> tuple[int, int]:
        """The next rank and position; the root must have a bit set."""
        x = self.root
        j = (x & -x).bit_length() - 1
        x = self.middle[j]
        i = (j << 6) + (x & -x).bit_length() - 1
        x = self.leaf[i]
        rank = (i << 6) + (x & -x).bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        x &= x - 1
        self.leaf[i] = x
        if not x:
            self.middle[j] = y = self.middle[j] & ~(1 << (i & 63))
            if not y:
                self.root &= ~(1 << j)
        return rank, bucket.pop()


class ByteBPE:
    """A vocabulary of ranks and the pattern that cuts pre-tokens. Rank is id; the lower rank merges first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.names = [str(i) for i in range(len(self.tokens))]
        self.pattern = regex.compile(pattern)
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.pieces = Memo()
        self.size = len(self.queue.buckets) + 1
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {
            ranks[token[:i]] * self.size + ranks[token[i:]]: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        }
        self.pairs = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[p] for p in self.pairs.tolist()], np.int32)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return cls(ranks, pattern)

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: the lowest rank is merged first, among equal ranks the leftmost."""
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if n < 2:
            return [self.ranks[piece]] if n else []
        queue = self.queue
        put, buckets, leaf, middle = queue.put, queue.buckets, queue.leaf, queue.middle
        # part p spans piece[p:after[p]]; filed[p] is the rank of the pair it starts, -1 for none
        after, before, filed = list(range(1, n + 2)), list(range(-1, n)), [-1] * (n + 1)
        for p in range(n - 1):
            rank = get(piece[p : p + 2])
            if rank is not None:
                filed[p] = rank
                put(rank, p)
        while queue.root:
            # queue.take(), written out: this loop is where encoding spends its time
            x = queue.root
            j = (x & -x).bit_length() - 1
            x = middle[j]
            i = (j << 6) + (x & -x).bit_length() - 1
            x = leaf[i]
            rank = (i << 6) + (x & -x).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                p = heappop(bucket)
            else:
                p = bucket.pop()
                leaf[i] = x = x & (x - 1)
                if not x:
                    middle[j] = x = middle[j] & (middle[j] - 1)
                    if not x:
                        queue.root &= queue.root - 1
            if filed[p] != rank:
                continue
            q = after[p]
            end = after[p] = after[q]
            filed[q] = filed[p] = -1
            before[end] = p
            if end < n:
                rank = get(piece[p : after[end]])
                if rank is not None:
                    filed[p] = rank
                    put(rank, p)
            left = before[p]
            if left >= 0:
                rank = get(piece[left:end])
                if rank is None:
                    filed[left] = -1
                elif rank != filed[left]:
                    filed[left] = rank
                    put(rank, left)
        ids, p = [], 0
        while p < n:
            ids.append(self.ranks[piece[p : after[p]]])
            p = after[p]
        return ids

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, -1 for none or where a side is no id."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], -1)

    def encode_short(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens that aren't empty, as bytes of 32-bit integers, merged together."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        n = len(data)
        barriers = np.cumsum(lengths + 1) - 1
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths + 1)
        ids = self.bytes[data]
        ids[barriers] = -1
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        filed = np.append(self._ranks_of(ids[:-1], ids[1:]), -1)
        self._file(filed, np.arange(n))
        queue = self.queue
        while queue.root:
            rank, places = queue.take_all()
            p = np.unique(places)
            p = p[filed[p] == rank]
            if len(p) > 1:
                mine = owner[p]
                again = np.append(False, mine[1:] == mine[:-1])
                if again.any():
                    queue.put_all(rank, p[again].tolist())
                    p = p[~again]
            if not len(p):
                continue
            q = after[p]
            end = after[q]
            after[p], before[end] = end, p
            ids[p], ids[q], filed[q] = rank, -2, -1
            left = before[p]
            filed[p] = here = self._ranks_of(ids[p], ids[end])
            # at the beginning of a pre-token the barrier of the one before it stands there
            filed[left] = there = self._ranks_of(ids[left], ids[p])
            self._file(np.concatenate([here, there]), np.concatenate([p, left]))
        kept = ids >= 0
        count = np.add.reduceat(kept, np.append(0, barriers[:-1] + 1))
        flat = ids[kept].astype("<i4").tobytes()
        ends = (4 * np.cumsum(count)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _file(self, ranks: np.ndarray, places: np.ndarray) -> None:
        """Put places into the buckets of their ranks; a rank of -1 is none."""
        ranks, places = ranks[ranks >= 0], places[ranks >= 0]
        if len(ranks) < 16:
            for rank, place in zip(ranks.tolist(), places.tolist(), strict=True):
                self.queue.put_all(rank, [place])
            return
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order].tolist()
        begins = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1])).tolist()
        for rank, a, b in zip(ranks[begins].tolist(), begins, [*begins[1:], len(places)], strict=True):
            self.queue.put_all(rank, places[a:b])

    def encode_new(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """The packed ids of pre-tokens that aren't remembered yet; short ones are remembered from now on."""
        made: dict[str, bytes] = {}
        names, group, size = [], [], 0

        def finish() -> None:
            made.update(zip(names, self.encode_short(group), strict=True))

        for name in pieces:
            piece = name.encode("utf-8", "replace")
            whole = self.ranks.get(piece)
            if whole is not None:
                made[name] = whole.to_bytes(4, "little")
            elif len(piece) > SHORT:
                made[name] = np.array(self.encode_piece(piece), "<i4").tobytes()
            else:
                names.append(name)
                group.append(piece)
                size += len(piece)
                if size >= TOGETHER:
                    finish()
                    names, group, size = [], [], 0
        if group:
            finish()
        for name, ids in made.items():
            if len(name) <= SHORT:
                self.pieces.keep(name, ids, len(name) + len(ids))
        return made

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of 32-bit integers. The new pre-tokens of all texts are merged together."""
        cuts = [self.pattern.findall(text) for text in texts]
        new, recall = self.pieces.new.get, self.pieces.recall
        known = {piece: new(piece) or recall(piece) for piece in set().union(*cuts)}
        known.update(self.encode_new([piece for piece, ids in known.items() if ids is None]))
        of = known.__getitem__
        return [b"".join(map(of, pieces)) for pieces in cuts]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, SHA-256 of the ids written out and of the bytes they decode to, for each text."""
        out = []
        for packed in self.encode_all(texts):
            ids = memoryview(packed).cast("i").tolist()
            written = ",".join(map(self.names.__getitem__, ids)).encode()
            out.append((len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()))
        return out


@functools.lru_cache(maxsize=2)
def loaded(path: str, pattern: str) -> ByteBPE:
    """The vocabulary, read once per worker. `path` must be there on every executor, as its library is."""
    return ByteBPE.from_file(path, pattern)


def _text_map(
    df: DataFrame, text: str, schema: str, make: Callable[[list[str], pa.Array, list[pa.DataType]], list[pa.Array]]
) -> DataFrame:
    """The table with columns made from slices of one text column of about `SLICE_BYTES`, or of one row."""
    new = StructType.fromDDL(schema)
    kept = [f for f in df.schema.fields if f.name != text and f.name not in new.names]
    names, types = [f.name for f in kept], _arrow_schema(df.sparkSession, new)
    types = [f.type for f in types]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, n in _slices(whole.column(len(names))):
                part = whole.slice(at, n)
                values = part.column(len(names))
                # millions of small objects without a cycle among them: looking for cycles costs a fifth
                gc.disable()
                try:
                    made = make([x or "" for x in values.to_pylist()], values, types)
                finally:
                    gc.enable()
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*names, *new.names])

    source = df.select(*[f"`{n}`" for n in names], f"`{text}`")
    return source.mapInArrow(run, StructType([*kept, *new.fields]))


def _slices(values: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = pc.binary_length(values).fill_null(0).to_pylist()
    begin = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > SLICE_BYTES:
            yield begin, i - begin
            begin, held = i, 0
        held += size
    if len(sizes) > begin:
        yield begin, len(sizes) - begin


def encode_texts(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds `ids` (array of int) and `decoded` (binary). NULL counts as empty; the text column is kept."""

    def make(texts, values, types):
        bpe = loaded(path, pattern)
        packed = bpe.encode_all(texts)
        ids = pa.array(np.frombuffer(b"".join(packed), "<i4"))
        begins = np.cumsum([0, *[len(p) // 4 for p in packed]]).astype(np.int32)
        decoded = pa.array([bpe.decode(np.frombuffer(p, "<i4").tolist()) for p in packed], types[2])
        return [values.cast(types[0]), pa.ListArray.from_arrays(pa.array(begins), ids).cast(types[1]), decoded]

    return _text_map(df, text, f"`{text}` string, ids array<int>, decoded binary", make)


def token_digests(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Replaces the text by `n_tokens`, `ids_sha256` and `decoded_sha256`; every row gives one row.

    NULL and empty texts have 0 ids and the digest of nothing; equal texts have equal results; an empty table gives an
    empty one; other columns are kept, those with the names of the results replaced.
    """

    def make(texts, values, types):
        columns = zip(*loaded(path, pattern).digests(texts), strict=True)
        return [pa.array(c, t) for c, t in zip(columns, types, strict=True)]

    return _text_map(df, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
