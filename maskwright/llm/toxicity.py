"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding disguises.

Folding undoes look-alike letters, digits and signs put for letters, case and full-width forms; what is no letter or
digit becomes one space. The lexicon holds whole words and beginnings of words, weighted by their log-odds between toxic
and other labelled texts. Hits inside an exception phrase don't count. The weights of a text's hits are summed, divided
by a slowly growing function of its length, and brought to 0..1 by a logistic curve fitted to the same labelled texts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import row_map

SAMPLE_PER_CLASS = 4000
MAX_ENTRIES = 5000
MIN_TEXTS = 5
MIN_LOG_ODDS = 3.0
PREFIXES = (4, 5, 6, 7, 8)

# Letters of other scripts that look like Latin ones, and signs and digits put for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "ε": "e", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ɩ": "i", "@": "a", "$": "s",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum", "sore loser")

_LETTERS = str.maketrans(LOOK_ALIKES | {"​": None, "‌": None, "‍": None, "­": None, "﻿": None})
_NUMBERS = str.maketrans(DIGITS)
_MIXED = re.compile(r"(?<!\w)(?:[^\W\d_]+\d|\d+[^\W\d_])\w*")
_BETWEEN = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Words of the text in plain form, one space around each; digits become letters in words that hold letters."""
    plain = (text or "").casefold()
    if not plain.isascii():
        plain = unicodedata.normalize("NFKC", plain).casefold()
    plain = _MIXED.sub(lambda m: m.group().translate(_NUMBERS), plain.translate(_LETTERS))
    return " " + _BETWEEN.sub(" ", plain).strip() + " "


@dataclass(frozen=True)
class Lexicon:
    """Entries begin with a space; those that end with one are whole words, the others beginnings of words."""

    entries: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 1.0
    offset: float = 0.0

    def matcher(self):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for entry, weight in self.entries:
            automaton.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            folded = fold(phrase)
            automaton.add_word(folded, (len(folded), None))
        if not len(automaton):
            return None
        automaton.make_automaton()
        return automaton


def strength(folded: str, automaton) -> tuple[float, int]:
    """Weights of the hits outside exceptions, by length, and the number of hits. Each word counts once at most."""
    if automaton is None:
        return 0.0, 0
    hits: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if weight is None:
            excused.append((start, end))
        else:
            hits[start] = max(weight, hits.get(start, 0.0))
    if excused:
        hits = _outside(hits, excused)
    words = folded.count(" ") - 1
    return sum(hits.values()) / (1 + math.log1p(max(0, words) / 50)), len(hits)


def _outside(hits: dict[int, float], spans: list[tuple[int, int]]) -> dict[int, float]:
    """The hits that begin in none of the spans, in one sweep over both in order."""
    spans.sort()
    out, i, until = {}, 0, -1
    for at in sorted(hits):
        while i < len(spans) and spans[i][0] <= at:
            until = max(until, spans[i][1])
            i += 1
        if at >= until:
            out[at] = hits[at]
    return out


def _entries(folded: str) -> set[str]:
    words = set(folded.split())
    found = {f" {w} " for w in words if len(w) > 2}
    for n in PREFIXES:
        found.update(f" {w[:n]}" for w in words if len(w) >= n)
    return found


def _text_counts(texts: DataFrame, only: frozenset[str] | None) -> DataFrame:
    """In how many texts each entry occurs; of given entries only, if any are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                counts: Counter[str] = Counter()
                for value in batch.column(0).slice(at, 200):
                    found = _entries(fold(value.as_py()))
                    counts.update(found if only is None else found & only)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["entry", "n"]
                )

    return texts.mapInArrow(run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def fit_lexicon(
    labelled: DataFrame,
    label: str = "label",
    text: str = "text",
    key: str = "doc_id",
    per_class: int = SAMPLE_PER_CLASS,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Lexicon:
    """Learn entries, weights and the curve from rows with a label of 0 or 1.

    At most `per_class` rows of each label are used, the ones with the lowest hash of the key, and at most MAX_ENTRIES
    entries kept, the heaviest. Without toxic rows, or too few to learn an entry from, the lexicon is empty and every text scores
    below one half.
    """
    known = labelled.filter(F.col(label).isin(0, 1))

    def sample(value: int) -> DataFrame:
        ids = known.filter(F.col(label) == value).select(key).orderBy(F.xxhash64(key), key).limit(per_class)
        return known.filter(F.col(label) == value).join(F.broadcast(ids.distinct()), key, "left_semi").select(text)

    toxic, other = sample(1), sample(0)
    n_toxic, n_other = toxic.count(), other.count()
    if not n_toxic:
        return Lexicon((), exceptions, 1.0, -5.0)
    least = max(MIN_TEXTS, n_toxic // 400)
    # Rows of the sample bound these: a text of the sample has entries in proportion to its words.
    frequent = _text_counts(toxic, None).filter(F.col("n") >= least).orderBy(F.desc("n"), "entry").limit(20 * MAX_ENTRIES)
    toxic_counts = {r[0]: r[1] for r in frequent.collect()}
    other_counts = {r[0]: r[1] for r in _text_counts(other, frozenset(toxic_counts)).collect()}

    def log_odds(entry: str) -> float:
        return math.log((toxic_counts[entry] + 0.5) / (n_toxic + 1)) - math.log((other_counts.get(entry, 0) + 0.5) / (n_other + 1))

    weighed = {e: w for e in toxic_counts if (w := log_odds(e)) >= MIN_LOG_ODDS}
    chosen: dict[str, float] = {}
    for entry in sorted(weighed, key=lambda e: (len(e.strip()), e)):
        # what a chosen beginning already covers as well adds nothing
        if not any(weighed[entry] <= chosen.get(entry[:n], -1.0) + 0.7 for n in range(2, len(entry))):
            chosen[entry] = weighed[entry]
    kept = sorted(chosen.items(), key=lambda x: (-x[1], x[0]))[:MAX_ENTRIES]
    if not kept:
        return Lexicon((), exceptions, 1.0, -5.0)
    lexicon = Lexicon(tuple(sorted(kept)), exceptions)
    points = [
        np.array([r[0] for r in score_texts(rows, lexicon, text).select("strength").collect()], float)
        for rows in (other, toxic)
    ]
    slope, offset = _curve(*points)
    return Lexicon(lexicon.entries, exceptions, slope, offset)


def _curve(other: np.ndarray, toxic: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic regression of the label on the strength, both labels weighing the same."""
    x = np.stack([np.concatenate([other, toxic]), np.ones(len(other) + len(toxic))], axis=1)
    y = np.concatenate([np.zeros(len(other)), np.ones(len(toxic))])
    weight = np.where(y == 1, 0.5 / max(1, len(toxic)), 0.5 / max(1, len(other)))
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (weight * (p - y)) + 1e-3 * w * [1, 0]
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def score_texts(df: DataFrame, lexicon: Lexicon, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Replaces the text (or keeps it) by `score`, `predicted`, `n_hits` and `strength`; one row for each row.

    NULL and empty texts have no hits. Equal texts score the same, repeated rows stay, an empty table gives an empty one;
    other columns are kept, those with the names of the results replaced.
    """

    def make():
        automaton = lexicon.matcher()

        def one(value):
            total, n = strength(fold(value), automaton)
            at = max(-500.0, min(500.0, lexicon.slope * total + lexicon.offset))
            score = 1 / (1 + math.exp(-at))
            return (*([value] if keep_text else []), score, int(score >= 0.5), n, total)

        return one

    kept = f"`{text}` string, " if keep_text else ""
    return row_map(df, text, f"{kept}score double, predicted int, n_hits long, strength double", make)
