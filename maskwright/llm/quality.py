"""Document quality by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of features of its text. The weights are learned from pairs of which one document
is labelled better: logistic loss on the difference of their features. The cut is a quantile of the strengths of all
labelled rows given for learning, at the share of poor ones among them; a score is the logistic of the distance to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import row_map

SAMPLE_PER_CLASS = 3000
PAIRS = 20_000
PENALTY = 1e-3
STEPS = 30
_SIGNS = b"!|%*&$#@.,;:?-_/<>{}[]()\"'="


def features(text: str | None) -> list[float]:
    """Shares of kinds of characters, shapes of words and lines, repetition. All 0 for NULL or empty texts."""
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return [0.0] * N_FEATURES
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = len(data)
    words, lines = data.split(), data.split(b"\n")
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    titled = sum(w[:1].isupper() for w in words)
    plain = sum(w.isalpha() or not w.isascii() for w in words)
    shares = [
        count[97:123].sum() / size,
        count[65:91].sum() / size,
        count[48:58].sum() / size,
        count[128:].sum() / size,
        count[[9, 10, 13, 32]].sum() / size,
        upper / n,
        titled / n,
        plain / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        len(set(words)) / n,
    ]
    sizes = [
        math.log1p(size),
        math.log1p(lengths.mean()),
        math.log1p(lengths.std()),
        math.log1p(lengths.max()),
        math.log1p(size / len(lines)),
    ]
    signs = [math.log1p(1000 * count[c] / size) for c in _SIGNS]
    return [float(x) for x in [*shares, *sizes, *signs]]


N_FEATURES = 16 + len(_SIGNS)


@dataclass(frozen=True)
class Ranking:
    """strength = features . weights; the score of a strength at `cut` is one half."""

    weights: tuple[float, ...]
    cut: float

    def strength(self, column: str = "features") -> Column:
        terms = [F.lit(w) * F.get(F.col(column), F.lit(i)) for i, w in enumerate(self.weights)]
        total = F.lit(0.0)
        for term in terms:
            total = total + term
        return total

    def score(self, column: str = "features") -> Column:
        distance = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), self.strength(column) - F.lit(self.cut)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-distance))


def add_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the text by `features`."""
    return row_map(df, text, "features array<double>", lambda: lambda value: (features(value),))


def fit_pairs(good: np.ndarray, poor: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> np.ndarray:
    """Bradley-Terry weights by Newton's method on the logistic loss of feature differences."""
    both = np.concatenate([good, poor])
    spread = both.std(axis=0)
    scale = np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 0.0)
    draw = np.random.default_rng(seed)
    d = (good[draw.integers(len(good), size=pairs)] - poor[draw.integers(len(poor), size=pairs)]) * scale
    w = np.zeros(d.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))
        slope = -(d * p[:, None]).mean(axis=0) + PENALTY * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + PENALTY * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w * scale


def fit_ranking(labelled: DataFrame, label: str = "label", key: str = "doc_id", per_class: int = SAMPLE_PER_CLASS) -> Ranking:
    """Learn from rows with `features` and a label of 0 or 1.

    The weights come from a sample of at most `per_class` rows of each label, the ones with the lowest hash of the key;
    the cut from all rows. Without both labels every document gets one half.
    """
    known = labelled.filter(F.col(label).isin(0, 1))

    def sample(value: int) -> np.ndarray:
        rows = known.filter(F.col(label) == value).orderBy(F.xxhash64(key), key).limit(per_class).select("features")
        return np.array([r[0] for r in rows.collect()], float).reshape(-1, N_FEATURES)

    good, poor = sample(1), sample(0)
    if not len(good) or not len(poor):
        return Ranking((0.0,) * N_FEATURES, 0.0)
    ranking = Ranking(tuple(float(x) for x in fit_pairs(good, poor)), 0.0)
    strengths = known.select(ranking.strength().alias("s"), F.col(label).alias("y"))
    share = float(strengths.agg(F.avg((F.col("y") == 0).cast("double"))).first()[0])
    below, above = strengths.agg(
        F.expr(f"percentile_approx(s, {max(0.0, share - 0.002)!r}, 10000)"),
        F.expr(f"percentile_approx(s, {min(1.0, share + 0.002)!r}, 10000)"),
    ).first()
    return Ranking(ranking.weights, (below + above) / 2)
