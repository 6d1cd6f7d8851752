"""A growing numpy hash table from words to runs of token ids; it replaces a dictionary of strings at a tenth of its memory.

A word is known by its identity: 128 bits of ``shingles.identities`` (its bytes, or a digest of long ones) and a tag with its size. The 64-bit hash only finds
the place; every hit compares the identity.
"""

from __future__ import annotations

import numpy as np

_FREE = np.uint64(0)
#: Entries before the store starts anew.
LIMIT = 2_000_000


class IdStore:
    def __init__(self, dtype: np.dtype, limit: int = LIMIT):
        self.dtype, self.limit = dtype, limit
        self.clear()

    def clear(self) -> None:
        self.bits, self.n, self.used = 16, 0, 0
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.entry = np.zeros(1 << self.bits, np.int32)
        self.starts, self.counts = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.words = np.zeros((1 << 12, 3), np.uint64)  # identities: low, high, tag
        self.flat = np.zeros(1 << 14, self.dtype)

    def _same(self, at: np.ndarray, hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
        known = self.words.take(self.entry[at], axis=0)
        return (self.keys[at] == hashes) & (known[:, 0] == words[:, 0]) & (known[:, 1] == words[:, 1]) & (known[:, 2] == words[:, 2])

    def get(self, hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The entry of each word (a row of ``words``), or -1."""
        hashes = np.maximum(hashes, np.uint64(1))
        mask = (1 << self.bits) - 1
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        hit = self._same(at, hashes, words)
        out = np.where(hit, self.entry[at], np.int32(-1))
        todo = np.flatnonzero(~hit & (self.keys[at] != _FREE))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            hit = self._same(at[todo], hashes[todo], words[todo])
            out[todo[hit]] = self.entry[at[todo[hit]]]
            todo = todo[~hit & (self.keys[at[todo]] != _FREE)]
        return out

    def add(self, hashes: np.ndarray, words: np.ndarray, ids: list[bytes]) -> None:
        """Store the ids of distinct words that the store does not hold."""
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        new = np.frombuffer(b"".join(ids), self.dtype)
        m = self.n + len(ids)
        if m > len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.zeros(m, x.dtype)]) for x in (self.starts, self.counts))
            self.words = np.concatenate([self.words, np.zeros((m, 3), np.uint64)])
        if self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(self.used + len(new), self.dtype)])
        self.flat[self.used : self.used + len(new)] = new
        self.starts[self.n : m] = self.used + np.cumsum(counts) - counts
        self.counts[self.n : m] = counts
        self.words[self.n : m] = words
        entries = np.arange(self.n, m, dtype=np.int32)
        self.n, self.used = m, self.used + len(new)
        if 2 * m > 1 << self.bits:
            full = self.keys != _FREE
            keys, old = self.keys[full], self.entry[full]
            while 2 * m > 1 << self.bits:
                self.bits += 1
            self.keys, self.entry = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._put(keys, old)
        self._put(np.maximum(hashes, np.uint64(1)), entries)

    def _put(self, keys: np.ndarray, entries: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = np.flatnonzero(self.keys[at] == _FREE)
            first = free[np.unique(at[free], return_index=True)[1]]  # one newcomer for each slot
            self.keys[at[first]], self.entry[at[first]] = keys[todo[first]], entries[todo[first]]
            left = np.ones(len(todo), bool)
            left[first] = False
            todo, at = todo[left], (at[left] + 1) & mask
