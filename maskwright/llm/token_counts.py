"""Token counts of texts of any length by overlap resynchronisation.

A huge text is encoded in overlapping chunks with offsets. Two neighbours are spliced at a place that both cut and that
no piece of the vocabulary can cross: a space behind another character, if no piece holds a space behind another
character (read from the vocabulary when it is loaded). Merges on its two sides never touch, so what either chunk has
on its own side of the place is what the whole text would have there. If the overlap holds no such place it is widened.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame

from maskwright.llm.common import row_map

CHUNK = 1 << 13
OVERLAP = 256
SPACE = "▁"
MARK = SPACE.encode()


class PieceCounter:
    """Counts pieces of a sentencepiece model."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.stable = not any(SPACE in p.lstrip(SPACE) for p in pieces)

    def count(self, text: str | None) -> tuple[int, int]:
        """The number of pieces, and at how many places chunks were spliced for it."""
        text = text or ""
        if len(text) <= 2 * self.chunk or not self.stable:
            return len(self.model.encode(text)), 0
        return self._spliced(text.encode("utf-8", "replace"))

    def _starts(self, data: bytes, begin: int, end: int) -> np.ndarray:
        """Where pieces of data[begin:end] start, as bytes of the whole text."""
        proto = self.model.encode(data[begin:end].decode("utf-8"), return_type="proto")
        return np.array([p.begin for p in proto.pieces], np.int64) + begin

    def _spliced(self, data: bytes) -> tuple[int, int]:
        """Pieces of the whole text, counted up to the last splice `at`; the rest of the chunk there is `left`."""
        n, total, begin, at, splices = len(data), 0, 0, 0, 0
        end, wide = _character(data, self.chunk), self.overlap
        left = self._starts(data, 0, end)
        while end < n:
            following = _character(data, max(at, end - wide))
            until = _character(data, min(n, following + self.chunk + wide))
            right = self._starts(data, following, until)
            place = self._common(data, left, right, following, end)
            if place is not None:
                total += int(((left >= at) & (left < place)).sum())
                splices += 1
                begin, end, at, left, wide = following, until, place, right, self.overlap
            elif following > at:
                wide *= 2
            else:  # the overlap reaches back to the last splice: take in more text on the right
                end = _character(data, min(n, end + (end - begin)))
                left, wide = self._starts(data, begin, end), self.overlap
        return total + int((left >= at).sum()), splices

    @staticmethod
    def _common(data: bytes, left: np.ndarray, right: np.ndarray, low: int, high: int) -> int | None:
        """A place inside both chunks where both cut and that is proven stable: the middle one."""
        both = np.intersect1d(left[(left > low) & (left < high)], right)
        good = [int(p) for p in both if data[p] == 32 and data[p - 1] != 32 and data[p - 3 : p] != MARK]
        return good[len(good) // 2] if good else None


def _character(data: bytes, place: int) -> int:
    """The place, or the start of the next character if it lies inside one."""
    while place < len(data) and data[place] & 0xC0 == 0x80:
        place += 1
    return place


@functools.lru_cache(maxsize=2)
def loaded(path: str, chunk: int, overlap: int) -> PieceCounter:
    return PieceCounter(path, chunk, overlap)


def count_tokens(
    df: DataFrame, path: str, limit: int, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """Replaces the text by `n_bytes`, `n_tokens`, `over_limit` (more than `limit` tokens) and `n_splices`, at how many places
    chunks were joined (0 for a text of at most two chunks); one row for each row.

    NULL counts as empty: no bytes, no tokens. Repeated rows stay; an empty table gives an empty one; other columns are
    kept, those with the names of the results replaced.
    """

    def make():
        counter = loaded(path, chunk, overlap)

        def one(value):
            n, splices = counter.count(value)
            return len((value or "").encode("utf-8", "replace")), n, n > limit, splices

        return one

    return row_map(df, text, "n_bytes long, n_tokens long, over_limit boolean, n_splices long", make)
