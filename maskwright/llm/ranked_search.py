"""Ranked lexical search of many queries at once, with what they share worked out once.

A query is a bag of terms. Terms that the same queries hold equally often are one shared set, and sets that stand together
in several queries are joined again and again, until no pair is left that two queries share. That gives a graph: at its
bottom the shared sets, above them sums of two nodes, at the top the queries as short lists of nodes. For a block of documents
the partial sum (accumulator) of every node is made once, from the bottom up, and each query adds up its few nodes.

Queries are worked through in blocks of bounded text, whose vocabulary and graph go to every task; each block reads the
documents once, keeps the places of its own terms only, and counts over all documents. A task keeps the best `k` of each
query, so what is shuffled is the queries times k times the tasks, not documents times queries.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.session import written

K = 10
BLOCK_BYTES = 8 << 20
BLOCK_CELLS = 4 << 20
PART = 1_000_000_000

# ASCII letters (small) and digits and every byte above ASCII stay, all else separates
_FOLD = bytes(
    b if b > 127 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """The terms of a text: runs of ASCII letters, digits and everything beyond ASCII; A-Z as small letters."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


class QueryGraph:
    """The queries' terms, the shared sets they form and the sums that lead from these to the queries.

    `vocabulary` numbers the terms, `base[t]` is the shared set of term t. Nodes from `n_base` on are sums of two nodes;
    `levels` lists them with their parts so that parts come first. Query q is the sum of `factor * node` over its
    edges, which begin at `starts[q]`.
    """

    def __init__(self, queries: list[list[bytes]]):
        holders: dict[bytes, list[tuple[int, int]]] = {}
        for q, words in enumerate(queries):
            for word, n in Counter(words).items():
                holders.setdefault(word, []).append((q, n))
        self.vocabulary = {word: t for t, word in enumerate(holders)}
        sets: dict[tuple, int] = {}
        self.base = np.array([sets.setdefault(tuple(h), len(sets)) for h in holders.values()], np.int64)
        self.n_base = len(sets)
        # one list of nodes for each query and number of repeats, the most shared sets first
        lists: dict[tuple[int, int], list[int]] = {}
        for held, node in sorted(sets.items(), key=lambda x: (-len(x[0]), x[1])):
            for q, n in held:
                lists.setdefault((q, n), []).append(node)
        self.sums: list[tuple[int, int]] = []
        self._join(list(lists.values()))
        edges = sorted((q, n, node) for (q, n), nodes in lists.items() for node in nodes)
        self.queries = np.array(sorted({q for q, _, _ in edges}), np.int64)
        self.starts = np.searchsorted(np.array([e[0] for e in edges]), self.queries)
        self.factors = np.array([e[1] for e in edges], np.int64)
        self.nodes = np.array([e[2] for e in edges], np.int64)
        self.n_nodes = self.n_base + len(self.sums)
        self.levels = self._levels()

    def _join(self, lists: list[list[int]]) -> None:
        """Replace neighbours that stand together in two lists or more by their sum, in place, until none are left."""
        while True:
            pairs = Counter(pair for nodes in lists for pair in zip(nodes, nodes[1:], strict=False))
            shared = {pair: n for pair, n in pairs.items() if n > 1}
            if not shared:
                return
            made: dict[tuple[int, int], int] = {}
            for nodes in lists:
                out, i = [], 0
                while i < len(nodes):
                    here = shared.get(tuple(nodes[i : i + 2]), 0)
                    if here and here >= shared.get(tuple(nodes[i + 1 : i + 3]), 0):
                        pair = (nodes[i], nodes[i + 1])
                        if pair not in made:
                            made[pair] = self.n_base + len(self.sums)
                            self.sums.append(pair)
                        out.append(made[pair])
                        i += 2
                    else:
                        out.append(nodes[i])
                        i += 1
                nodes[:] = out

    def _levels(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        depth = [0] * self.n_base
        for a, b in self.sums:
            depth.append(1 + max(depth[a], depth[b]))
        levels: dict[int, list[tuple[int, int, int]]] = {}
        for i, (a, b) in enumerate(self.sums, self.n_base):
            levels.setdefault(depth[i], []).append((i, a, b))
        return [tuple(np.array(x, np.int64) for x in zip(*levels[d], strict=True)) for d in sorted(levels)]

    def scores(self, places: np.ndarray, columns: np.ndarray, amounts: np.ndarray, width: int) -> np.ndarray:
        """Scores (queries x documents) from what term places[i] adds to the document in column columns[i]."""
        sums = np.zeros((self.n_nodes, width), np.int64)
        np.add.at(sums, (self.base[places], columns), amounts)
        for node, a, b in self.levels:
            sums[node] = sums[a] + sums[b]
        return np.add.reduceat(sums[self.nodes] * self.factors[:, None], self.starts, axis=0)


class Best:
    """The k best documents of each query so far: higher scores first, then smaller ids, rows without an id last."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.found = k, np.zeros(n, np.int64), []
        self.held, self.bound = 0, max(1 << 16, 4 * n * k)

    def add(self, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        floor = np.maximum(self.least, 1)
        if scores.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
        query, column = np.nonzero(scores >= floor[:, None])
        self.found.append((query, scores[query, column], absent[column], ids[column]))
        self.held += len(query)
        if self.held > self.bound:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        query, score, absent, ids = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((ids, absent, -score, query))
        query, score, absent, ids = query[order], score[order], absent[order], ids[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        self.least[query[rank == self.k - 1]] = score[rank == self.k - 1]
        kept = rank < self.k
        best = query[kept], score[kept], absent[kept], ids[kept]
        self.found, self.held = [best], int(kept.sum())
        return best


def _index(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """For each document with terms: its key, `n` terms with repeats, and the queries' terms in it with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = []
                for value in batch.column(1):
                    words = terms(value.as_py())
                    held = {vocabulary[w]: n for w, n in Counter(words).items() if w in vocabulary}
                    rows.append((len(words), list(held), list(held.values())))
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())))]
                out = pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["key", "n", "term", "tf"])
                yield out.filter(pa.array([r[0] > 0 for r in rows]))

    source = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(run, "key long, n long, term array<int>, tf array<long>")


def _best(index: DataFrame, graph: QueryGraph, n_docs: int, n_terms: int, weights: np.ndarray, k: int) -> DataFrame:
    """The k best of every query within each task."""
    width = max(1, BLOCK_CELLS // (graph.n_nodes + len(graph.nodes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(graph.queries), k)
        for whole in batches:
            for at in range(0, whole.num_rows, width):
                batch = whole.slice(at, width)
                key, lists = batch.column(0), batch.column(2)
                size = [25 + 75 * n * n_docs // n_terms for n in batch.column(1).to_pylist()]
                term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                tf = batch.column(3).flatten().to_numpy(zero_copy_only=False)
                column = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                amount = weights[term] * ((PART * tf) // (1000 * tf + 8 * np.array(size, np.int64)[column]))
                absent = key.is_null().to_numpy(zero_copy_only=False)
                ids = key.fill_null(0).to_numpy(zero_copy_only=False)
                best.add(graph.scores(term, column, amount, batch.num_rows), ids, absent)
        if best.found:
            query, score, absent, ids = best.cut()
            yield pa.RecordBatch.from_arrays(
                [pa.array(graph.queries[query]), pa.array(ids, pa.int64(), mask=absent), pa.array(score)],
                names=["query", "key", "score"],
            )

    return index.mapInArrow(run, "query long, key long, score long")


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    doc_key: str = "doc_id",
    item_key: str = "item_id",
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The `k` documents with the highest score above 0 for each row of `items`: item key, rank, document key, score.

    Terms are what `terms` finds. With N documents that hold a term, L terms in them, n of them in one document, and df
    documents that hold a term which occurs there tf times, a document's score is the sum over the item's terms, repeats
    included, of w * (10**9 * tf div (1000 * tf + 8 * m)), where w = floor(1000 * ln((2N + 2) / (2df + 1))) and
    m = 25 + (75 * n * N div L).

    NULL and empty texts have no terms: such a document is not counted, such an item has no rows. Equal scores come by
    ascending key, rows without a key last. Repeated documents count and rank one by one; an item that stands there twice, or
    without a key, is answered each time. An empty table on either side gives no rows. Other columns are ignored.
    Runs jobs when called: items are collected to the driver in blocks of about `block_bytes` of text.
    """
    rows = items.select(F.col(f"`{item_key}`").alias("item"), F.col(f"`{text}`").alias("text"))
    rows = written(rows.withColumn("query", F.monotonically_increasing_id()), "search-items")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / block_bytes))
    answers = None
    for block in range(n_blocks):
        part = rows.filter(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == block).orderBy("query").collect()
        graph = QueryGraph([terms(r.text) for r in part])
        if not len(graph.queries):
            continue
        graph.queries = np.array([r["query"] for r in part], np.int64)[graph.queries]
        index = written(_index(docs, doc_key, text, graph.vocabulary), "search-index")
        n_docs, n_terms = index.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        held = index.select(F.explode("term").alias("t")).groupBy("t").count().collect()
        weights = np.zeros(len(graph.vocabulary), np.int64)
        for t, df in held:
            weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        found = _best(index, graph, n_docs, n_terms, weights, k)
        answers = found if answers is None else answers.unionByName(found)
    if answers is None:
        answers = docs.sparkSession.createDataFrame([], "query long, key long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("key").asc_nulls_last())
    ranked = answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(rows.select("query", "item"), "query").select(
        F.col("item").alias(item_key), "rank", F.col("key").alias(doc_key), "score"
    )
