"""Longest pieces first, in one pass over a word: a trie with failure links and pops.

A word is cut by always taking the longest known piece; pieces inside a word are marked. Walking down the trie letter by
letter, a dead end doesn't mean going back: for every node it was worked out beforehand which pieces the letters so far
begin with (its pops) and which node inside a word stands for the rest (its failure link).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Mapping

import numpy as np

INSIDE = "##"
SHIFT = 21  # a code point has 21 bits


class PieceTrie:
    """Ids of pieces by name. A piece that begins with the mark also stands inside words; as it is written it may begin one."""

    def __init__(self, pieces: Mapping[str, int]):
        self.step: dict[int, int] = {}
        self.ids: list[int | None] = [None, None]  # node 0: before a word, node 1: inside it
        for piece, number in pieces.items():
            self._add(0, piece, number)
            if piece.startswith(INSIDE):
                self._add(1, piece[len(INSIDE) :], number)
        self.link: list[int] = [-1] * len(self.ids)
        self.pops: list[tuple[int, ...]] = [()] * len(self.ids)
        self._join()

    def _add(self, node: int, text: str, number: int) -> None:
        if not text:
            return
        for letter in text:
            key = node << SHIFT | ord(letter)
            following = self.step.get(key)
            if following is None:
                following = self.step[key] = len(self.ids)
                self.ids.append(None)
            node = following
        self.ids[node] = number

    def _join(self) -> None:
        children: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.step.items():
            children.setdefault(key >> SHIFT, []).append((key & (1 << SHIFT) - 1, node))
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for letter, node in children.get(parent, ()):
                queue.append(node)
                if self.ids[node] is not None:
                    self.link[node], self.pops[node] = 1, (self.ids[node],)
                    continue
                pops, at = self.pops[parent], self.link[parent]
                while at >= 0 and at << SHIFT | letter not in self.step:
                    pops, at = pops + self.pops[at], self.link[at]
                if at >= 0:
                    self.link[node], self.pops[node] = self.step[at << SHIFT | letter], pops

    def cut(self, word: str) -> list[int] | None:
        """The ids of a word's pieces; None if it can't be cut to its end, or is empty."""
        step, link, pops = self.step, self.link, self.pops
        node, found = 0, []
        for letter in word:
            following = step.get(node << SHIFT | ord(letter))
            while following is None:
                if link[node] < 0:
                    return None
                found += pops[node]
                node = link[node]
                following = step.get(node << SHIFT | ord(letter))
            node = following
        while node != 1:
            if link[node] < 0:
                return None
            found += pops[node]
            node = link[node]
        return found


class WordCutter:
    """Cuts lists of words; a word that can't be cut, or is too long, is the unknown piece. Short words are remembered."""

    def __init__(self, pieces: Mapping[str, int], unknown: int, max_length: int | None, remembered: int = 200_000):
        self.trie, self.unknown, self.max_length = PieceTrie(pieces), [unknown], max_length
        self.remembered, self.known = remembered, {}

    def _cut(self, word: str) -> list[int]:
        if self.max_length is not None and len(word) > self.max_length:
            return self.unknown
        return self.trie.cut(word) or self.unknown

    def __call__(self, words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words behind each other, and how many each word has."""
        if len(self.known) > self.remembered:
            self.known.clear()
        known, cuts = self.known, []
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = self._cut(word)
                if len(word) <= 32:
                    known[word] = ids
            cuts.append(ids)
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
        flat = np.fromiter((i for ids in cuts for i in ids), np.int64, int(sizes.sum()))
        return flat, sizes
