"""Pair-merge tables that byte-pair encoders look up, as sorted arrays."""

from __future__ import annotations

import heapq

import numpy as np

#: Rank of a pair that is never merged.
NEVER = np.int64(1 << 40)
_BASE = 1 << 20


class PairTable:
    """Ranks and results of the merges (left, right) -> merged."""

    def __init__(self, left, right, merged, rank):
        key = np.asarray(left, np.int64) * _BASE + np.asarray(right, np.int64)
        order = np.argsort(key)
        self.keys = key[order]
        self.merged = np.asarray(merged, np.int32)[order]
        self.ranks = np.asarray(rank, np.int64)[order]
        self._pairs: dict[tuple[int, int], tuple[int, int]] | None = None

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NEVER without a merge), and what it becomes."""
        key = left.astype(np.int64) * _BASE + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NEVER), self.merged[at]

    def merge_long(self, symbols: list[int]) -> list[int]:
        """Merges one long sequence: lowest rank first, of equal ranks the leftmost.

        A heap takes n log n steps where a scan of the whole array for each merge would
        take n squared."""
        if self._pairs is None:
            self._pairs = {(int(k) // _BASE, int(k) % _BASE): (int(r), int(m)) for k, r, m in zip(self.keys, self.ranks, self.merged, strict=True)}
        pairs, n = self._pairs, len(symbols)
        symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*pairs[p], i, *p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in pairs]
        heap = [(rank, i, left, right, new) for rank, new, i, left, right in heap]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if j >= n or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i], symbols[j], after[i] = new, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (hit := pairs.get((symbols[a], symbols[b]))):
                    heapq.heappush(heap, (hit[0], a, symbols[a], symbols[b], hit[1]))
        return [s for s in symbols if s >= 0]
