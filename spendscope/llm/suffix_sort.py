"""Sorting suffixes by hash-compared common extensions.

Two suffixes are compared by the length of their common extension, found by binary search over prefix polynomial
hashes, and the byte behind it: a logarithmic number of hash comparisons, whatever the length. The sort is a
bottom-up mergesort; all runs of a level are merged at once, each element finding its rank in its sibling run.
"""

from __future__ import annotations

import numpy as np

from spendscope.llm.byte_hash import of_bytes


class Suffixes:
    """Suffixes of a buffer, given by start and (possibly cut) length."""

    def __init__(self, buffer: bytes, start: np.ndarray, length: np.ndarray):
        self.bytes = np.frombuffer(buffer, np.uint8)
        self.hashes = of_bytes(buffer)
        self.start, self.length = start, length

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes i and j."""
        a, b = self.start[i], self.start[j]
        low = np.zeros(len(i), np.int64)
        high = np.minimum(self.length[i], self.length[j])
        for _ in range(int(high.max(initial=0)).bit_length()):
            middle = (low + high + 1) >> 1
            same = self.hashes.of(a, a + middle) == self.hashes.of(b, b + middle)
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray, or_equal: bool) -> np.ndarray:
        common = self.extension(i, j)
        end_i, end_j = common == self.length[i], common == self.length[j]
        last = len(self.bytes) - 1
        before = self.bytes[np.minimum(self.start[i] + common, last)] < self.bytes[np.minimum(self.start[j] + common, last)]
        return np.where(end_i, ~end_j | or_equal, ~end_j & before)

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Indices by group, then by suffix; equal suffixes in input order."""
        order = np.argsort(group, kind="stable")
        ranked = group[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        size = np.diff(np.concatenate([first, [len(order)]]))
        base, count = np.repeat(first, size), np.repeat(size, size)
        place = np.arange(len(order)) - base  # within the group
        width, most = 1, int(size.max(initial=0))
        while width < most:
            active = np.flatnonzero(count > width)
            at, own = place[active], base[active]
            run = at // width
            left = run % 2 == 0
            sibling = np.where(left, run + 1, run - 1) * width
            low = np.minimum(sibling, count[active])
            top = np.minimum(sibling + width, count[active])
            start = low.copy()
            open_ = low < top
            while open_.any():
                k = np.flatnonzero(open_)
                middle = (low[k] + top[k]) >> 1
                mine, other = order[own[k] + at[k]], order[own[k] + middle]
                # elements of the left run go before equal ones of the right run
                ahead = np.where(left[k], self.less(other, mine, False), self.less(other, mine, True))
                low[k] = np.where(ahead, middle + 1, low[k])
                top[k] = np.where(ahead, top[k], middle)
                open_ = low < top
            pair = run // 2 * 2 * width
            merged = own + pair + (at - run * width) + (low - start)
            values = order[own + at]
            order[merged] = values
            width *= 2
        return order

    def neighbours(self, order: np.ndarray, group: np.ndarray) -> np.ndarray:
        """For each place, the common extension with the place before; -1 where a group begins."""
        lcp = np.full(len(order), -1, np.int64)
        if len(order) > 1:
            same = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
            lcp[same] = self.extension(order[same], order[same - 1])
        return lcp
