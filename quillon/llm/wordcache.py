"""Token ids of the words of a column, each distinct word encoded once per task.

Distinct words are known by two 64-bit hashes.  A worker keeps the ids of up to
``limit`` words; beyond that, new words are encoded again in each slice.  Only
time depends on it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import textops as tx


class WordCache:
    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], kind: type = np.uint16, limit: int = 1_500_000):
        self.encode, self.kind, self.limit = encode, kind, limit
        self.key = np.zeros(0, np.uint64)
        self.check = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(0, kind)

    def _fresh(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = buf.tobytes()
        lists = self.encode([raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        size = np.fromiter(map(len, lists), np.int32, len(lists))
        flat = np.fromiter((i for ids in lists for i in ids), self.kind, int(size.sum()))
        return flat, size

    def lookup(self, words: tx.Words, tag: np.ndarray | None = None, mark: Callable[[np.ndarray], tuple] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words after one another, and the number of ids of each.

        ``tag`` (small integers) makes equal bytes of unequal tags different words;
        ``mark(rows)`` then gives buffer, starts and ends of those words' full bytes.
        """
        h, g = words.hashes(0), words.hashes(1)
        if tag is not None:
            h, g = h ^ tx.mix(tag.astype(np.uint64), 5), g ^ tx.mix(tag.astype(np.uint64), 6)
        key, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if not (g[first][inverse] == g).all():  # two words share a hash: tell them apart by both
            h = tx.mix(h ^ tx.mix(g, 9), 10)
            key, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        check = g[first]
        place = np.searchsorted(self.key, key)
        inside = np.minimum(place, max(0, len(self.key) - 1))
        known = (self.key[inside] == key) & (self.check[inside] == check) if len(self.key) else np.zeros(len(key), bool)
        at, size = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        at[known], size[known] = self.at[inside[known]], self.size[inside[known]]
        ids = self.ids
        new = np.flatnonzero(~known)
        if len(new):
            rows = first[new]
            buf, start, end = mark(rows) if mark else (words.buf, words.start[rows], words.end[rows])
            flat, sizes = self._fresh(buf, start, end)
            at[new] = len(ids) + np.cumsum(sizes) - sizes
            size[new] = sizes
            ids = np.concatenate([ids, flat])
            if len(self.key) + len(new) <= self.limit:
                self.ids = ids
                self.key, self.check = np.insert(self.key, place[new], key[new]), np.insert(self.check, place[new], check[new])
                self.at, self.size = np.insert(self.at, place[new], at[new]), np.insert(self.size, place[new], sizes)
        per_word = size[inverse]
        flat, _ = tx.gather(ids, at[inverse], per_word)
        return flat, per_word
