"""Grouping of spelling variants: words one edit apart, found with an FM-index in both directions.

If two words differ by one inserted, deleted or replaced letter, and one of them is cut in halves, the other holds one half
unchanged, at its beginning or its end. So each search matches one half exactly and goes on across the other, where one
error is allowed: the first half from left to right, the second from right to left. Each word is filed under both halves, and
those filed together meet in one shard. A shard's words, with a mark before, between and behind them, make up two indexes, of
the text and of the reversed text; a search narrows an interval of suffix ranks letter by letter, for all words at once.
An interval "mark, letters, mark" is one word. With two parts a search never turns round, so the two indexes need no
common interval.

Words that are filed together in too great a number are filed anew with the part that may hold the error halved again,
until a shard is bounded. Each pair is found in one place only: under the unchanged beginning if there is one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.operators.skew import hot_split_join
from maskwright.session import written

LEAST_LENGTH = 6
LEAST_COUNT = 5
FACTOR = 5
SHARD_LETTERS = 1 << 20
GROUP_WORDS = 100_000
HELD_WORDS = 300_000
NO_BAR = 1 << 30

# one byte a letter: A-Z as small letters, a-z, U+00C0 to U+00FF; all else separates
_FOLD = bytes(b if 97 <= b <= 122 or b >= 192 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def runs(text: str | None) -> list[bytes]:
    """Runs of the letters A-Z, a-z and U+00C0 to U+00FF in Latin-1, only A-Z as small letters."""
    return (text or "").encode("latin-1", "replace").translate(_FOLD).split()


def count_words(df: DataFrame, key: str = "doc_id", text: str = "text", misspell: int = 199, shortest: int = LEAST_LENGTH) -> DataFrame:
    """`word` and `n`, how often it occurs, for words of at least `shortest` letters.

    With `misspell` above 0 the run of a document loses its letter h % length if that number divides h, the CRC-32 of "key:run"; a
    NULL key is written as nothing. NULL and empty texts have no words; repeated rows count each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for name, value in zip(*batch.columns, strict=True):
                start = zlib.crc32(b"%s:" % (name.as_py() or "").encode())
                for word, n in Counter(runs(value.as_py())).items():
                    if len(word) < shortest:
                        continue
                    if misspell:
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if h % misspell == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < shortest:
                                continue
                    held[word] += n
            if len(held) > HELD_WORDS:
                yield _counted(held)
                held.clear()
        if held:
            yield _counted(held)

    source = df.select(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`"))
    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: Counter) -> pa.RecordBatch:
    words = pa.array([w.decode("latin-1") for w in held], pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], names=["word", "n"])


class Index:
    """Suffix ranks of a text of codes, sorted as deep as any search goes; code 0 is the mark."""

    def __init__(self, codes: np.ndarray, depth: int):
        self.n = n = len(codes)
        self.n_marks = int((codes == 0).sum())
        bits = max(1, int(codes.max()).bit_length())
        reach = max(1, 62 // bits)
        padded = np.concatenate([codes, np.zeros(reach, codes.dtype)])
        rank = np.zeros(n, np.int64)
        for i in range(min(reach, depth)):
            rank = (rank << bits) | padded[i : i + n]
        order = np.argsort(rank, kind="stable")
        while reach < depth:
            change = np.concatenate([[0], rank[order][1:] != rank[order][:-1]])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(change)
            if rank[order[-1]] == n - 1:
                break
            later = np.concatenate([rank[reach:], np.full(min(reach, n), -1)])
            rank = rank * (n + 1) + later + 1
            order = np.argsort(rank, kind="stable")
            reach *= 2
        self.suffixes = order
        # nothing stands before the text; that place comes first, as the last mark comes first of all suffixes
        self.before = np.where(order > 0, codes[order - 1], -1).astype(np.int64)
        places = np.argsort(self.before, kind="stable")
        self.ranks = self.before[places] * n + places

    def extend(self, low: np.ndarray, high: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals with the code put before what they stand for."""
        return np.searchsorted(self.ranks, code * self.n + low), np.searchsorted(self.ranks, code * self.n + high)

    def every(self, low: np.ndarray, high: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For each interval every letter that may be put before it: number of the interval and code."""
        wide = high - low > size
        few = np.flatnonzero(~wide)
        width = (high - low)[few]
        row = np.repeat(few, width)
        at = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width) + low[row]
        code = self.before[at]
        listed = np.unique(row[code > 0] * size + code[code > 0])
        letters = np.arange(1, size)
        row = np.concatenate([listed // size, np.repeat(np.flatnonzero(wide), size - 1)])
        return row, np.concatenate([listed % size, np.tile(letters, int(wide.sum()))])


def search(index: Index, size: int, codes: np.ndarray, begins: np.ndarray, lengths: np.ndarray, step: int, low_error: np.ndarray, high_error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words given by where they begin in `codes` and the direction of reading: pairs of a word's number and the suffix rank
    of a word that differs by one error between the places `low_error` and `high_error`, or not at all."""
    zero = np.zeros(len(begins), np.int64)
    low, high = zero, zero + index.n_marks
    word = np.arange(len(begins))
    wrong = (np.zeros(0, np.int64),) * 3  # word, low, high of searches that have had their error
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for j in range(int(lengths.max(initial=-1)) + 1):
        # another letter stands here, or the one here is left out or replaced
        able = (low_error[word] <= j) & (j <= high_error[word])
        row, code = index.every(low[able], high[able], size)
        w, a, b = word[able], low[able], high[able]
        a2, b2 = index.extend(a[row], b[row], code)
        ends = lengths[w] == j
        inside = (high_error[w] > j) & ~ends
        wrong = tuple(np.concatenate(x) for x in zip(wrong, (w[row], a2, b2), strict=True))
        here = np.where(ends, 0, codes[np.where(ends, 0, begins[w] + step * j)])
        replaced = inside[row] & (code != here[row])
        skipped = (np.concatenate([w[inside], w[row][replaced]]), np.concatenate([a[inside], a2[replaced]]), np.concatenate([b[inside], b2[replaced]]))
        # words that end here: the mark must follow
        over = lengths[wrong[0]] == j
        a, b = index.extend(wrong[1][over], wrong[2][over], np.zeros(int(over.sum()), np.int64))
        found.append((wrong[0][over][b > a], a[b > a]))
        wrong = tuple(np.concatenate([x, y]) for x, y in zip(_next(index, codes, begins, step, j, *(x[~over] for x in wrong)), skipped, strict=True))
        on = lengths[word] > j
        word, low, high = _next(index, codes, begins, step, j, word[on], low[on], high[on])
    return np.concatenate([x[0] for x in found] or [zero]), np.concatenate([x[1] for x in found] or [zero])


def _next(index: Index, codes: np.ndarray, begins: np.ndarray, step: int, j: int, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """The searches that go on with letter j of their words."""
    low, high = index.extend(low, high, codes[begins[word] + step * j].astype(np.int64))
    on = high > low
    return word[on], low[on], high[on]


def near_words(filed: list[tuple[str, int, int, int, int, bool]]) -> list[tuple[str, int, int, str]]:
    """Of the words filed in a shard (word, n, a, b, bar, asked): for each that is asked about and has near words which share its
    first a and last b letters, but not the first `bar`: word, number of near words, the largest n and its word."""
    counts = {row[0]: row[1] for row in filed}
    words = sorted(counts)
    asked = [row for row in filed if row[5]]
    if not asked:
        return []
    data = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("latin-1"), np.uint8)
    letters, codes = np.unique(data, return_inverse=True)
    marks = np.flatnonzero(data == 0)
    size, n = len(letters), len(data)
    codes = codes.astype(np.int64)
    number = {w: i for i, w in enumerate(words)}
    mine = np.array([number[row[0]] for row in asked])
    lengths = np.diff(marks)[mine] - 1
    a, b, bar = (np.array([row[i] for row in asked], np.int64) for i in (2, 3, 4))
    depth = int(np.diff(marks).max()) + 2
    pairs: list[np.ndarray] = []
    for forward in (True, False):
        part = np.flatnonzero((a >= b) == forward)
        if not len(part):
            continue
        # letters are put before what is matched, so reading forward needs the reversed text
        index = Index(codes[::-1] if forward else codes, depth)
        begin = marks[mine[part]] + 1 if forward else marks[mine[part] + 1] - 1
        first, last = (a, b) if forward else (b, a)
        word, rank = search(index, size, codes, begin, lengths[part], 1 if forward else -1, first[part], (lengths - last)[part])
        at = index.suffixes[rank]
        other = np.searchsorted(marks, n - 1 - at) - 1 if forward else np.searchsorted(marks, at)
        pairs.append(np.stack([part[word], other], 1))
    both = np.unique(np.concatenate(pairs), axis=0)
    query, other = both[mine[both[:, 0]] != both[:, 1]].T
    if len(query):
        own = [words[i] for i in mine[query]]
        good = np.array([bar[q] == NO_BAR or u[: bar[q]] != words[v][: bar[q]] for q, u, v in zip(query, own, other, strict=True)], bool)
        query, other = query[good], other[good]
    size_of = np.array([counts[w] for w in words], np.int64)
    order = np.lexsort((other, -size_of[other], query))
    query, other = query[order], other[order]
    which, at, many = np.unique(query, return_index=True, return_counts=True)
    return [(asked[q][0], int(m), int(size_of[other[i]]), words[other[i]]) for q, i, m in zip(which, at, many, strict=True)]


_KEY = ["l", "a", "b", "bar", "pre", "suf"]
_FILED = "word string, n long, a int, b int, bar int, asked boolean"


def _filed(words: DataFrame, group: int) -> DataFrame:
    """Every word under the halves of the words it may be near to: of its own length, where it is asked about, one less and one more."""
    each = words.select("word", "n", F.length("word").alias("m")).withColumn("l", F.explode(F.expr("array(m - 1, m, m + 1)")))
    each = each.filter("l > 0").withColumn("asked", F.col("l") == F.col("m")).drop("m")
    halves = f"inline(array(struct(int(l div 2) AS a, 0 AS b, {NO_BAR} AS bar), struct(0 AS a, int(l - l div 2) AS b, int(l div 2) AS bar)))"
    filed = each.select("word", "n", "l", "asked", F.expr(halves)).filter("a + b < l")
    filed = written(_under(filed), "variants-filed")
    while True:
        sizes = filed.groupBy(*_KEY).count().filter((F.col("count") > group) & F.expr("l - a - b > 1"))
        great = written(sizes.select(*_KEY), "variants-great")
        if great.isEmpty():
            return filed
        # at most one key for `group` words
        great = F.broadcast(great)
        again = filed.join(great, _KEY, "left_semi").withColumn("h", F.expr("int((l - a - b) div 2)"))
        halves = "inline(array(struct(a + h AS a, b, bar), struct(a, l - a - h AS b, least(bar, a + h) AS bar)))"
        again = again.select("word", "n", "l", "asked", F.expr(halves))
        filed = written(filed.join(great, _KEY, "left_anti").unionByName(_under(again)), "variants-filed")


def _under(filed: DataFrame) -> DataFrame:
    return filed.withColumn("pre", F.expr("left(word, a)")).withColumn("suf", F.expr("right(word, b)"))


def near(words: DataFrame, shard: int = SHARD_LETTERS, group: int = GROUP_WORDS) -> DataFrame:
    """For each of the words that is near another: `word`, `n_near`, and `best`: the largest n of a near word (negative) and the first
    such word."""
    filed = _filed(words, group)
    letters = filed.agg(F.sum(F.length("word") + 1)).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
        made = near_words(rows)
        if made:
            types = (pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "form_n", "form"])

    dealt = filed.repartition(1 + letters // shard, *_KEY).select("word", "n", "a", "b", "bar", "asked")
    found = dealt.mapInArrow(run, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)


def _roots(links: DataFrame) -> DataFrame:
    """Where the forms lead to: `form` and `root`, for forms that have a form themselves. Each round goes twice as far."""
    steps = links.select(F.col("word").alias("form"), F.col("form").alias("root"))
    steps = written(steps.join(links.select("form").distinct(), "form", "left_semi"), "variants-steps")
    while True:
        further = steps.select(F.col("form").alias("root"), F.col("root").alias("next"))
        if steps.join(further, "root", "left_semi").isEmpty():
            return steps
        joined = hot_split_join(steps, further, ["root"], ["form"])
        steps = written(joined.select("form", F.coalesce("next", "root").alias("root")), "variants-steps")


def group_variants(
    words: DataFrame, least: int = LEAST_COUNT, factor: int = FACTOR, shard: int = SHARD_LETTERS, group: int = GROUP_WORDS
) -> DataFrame:
    """Each word with n >= `least`: `word`, `form`, `root`, `n`, `n_near`, `form_n`.

    `words` has unique `word` (letters up to U+00FF) and `n`; other columns are ignored. Two words are near if they differ by
    one inserted, deleted or replaced letter. The form of a word is its near word of largest n, the first in code point
    order among equals, if that n is at least `factor` times the word's; else NULL, as is `form_n`. `root` follows forms to
    the last one, and is the word itself if it has none. An empty table gives an empty one. Runs jobs when called.
    """
    words = written(words.select("word", "n").filter(F.col("n") >= least), "variants-words")
    known = words.join(near(words, shard, group), "word", "left")
    good = F.col("best.less") <= -factor * F.col("n")
    known = known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("best.form")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n"),
    )
    known = written(known, "variants-known")
    roots = _roots(known.filter("form is not null").select("word", "form"))
    named = hot_split_join(known, roots, ["form"], ["word"])
    return named.select("word", "form", F.coalesce("root", "form", "word").alias("root"), "n", "n_near", "form_n")
