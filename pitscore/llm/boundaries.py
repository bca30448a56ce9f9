"""Sets of 32-bit positions in containers of 65,536, with rank and select.

A container holds the positions that share their upper 16 bits in the smallest of three forms: a sorted
array of the lower bits, a bitmap, or runs (first value, length). Cumulative cardinalities over containers, over
the words of a bitmap and over runs lead ``select`` to its container and then to the place inside it.
"""

from __future__ import annotations

import numpy as np

CONTAINER, WORDS = 1 << 16, 1 << 10
ARRAY, BITMAP, RUNS = 0, 1, 2


def _words(low: np.ndarray) -> np.ndarray:
    """Bitmap of sorted values below 65,536 as 1,024 words of 64 bits."""
    bits = np.zeros(CONTAINER, np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def _place_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the ``k``-th set bit (from 0) of each word: halves are counted, six steps."""
    word, place, k = word.copy(), np.zeros(len(word), np.int64), k.copy()
    for width in (32, 16, 8, 4, 2, 1):
        half = word & np.uint64((1 << width) - 1)
        n = np.bitwise_count(half).astype(np.int64)
        up = k >= n
        k -= np.where(up, n, 0)
        place += np.where(up, width, 0)
        word = np.where(up, word >> np.uint64(width), half)
    return place


class Container:
    """Positions with the same upper bits, in the form that takes the least bytes."""

    def __init__(self, low: np.ndarray):
        self.n = len(low)
        first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1] + 1)))
        sizes = {ARRAY: 2 * self.n, BITMAP: CONTAINER // 8, RUNS: 4 * len(first)}
        self.form = min(sizes, key=sizes.get)
        if self.form == ARRAY:
            self.values = low.astype(np.uint16)
        elif self.form == BITMAP:
            self.values = _words(low)
            self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.values).astype(np.int64))))
        else:
            length = np.diff(np.append(first, self.n))
            self.values = low[first].astype(np.uint16)
            self.before = np.concatenate(([0], np.cumsum(length)))

    def select(self, k: np.ndarray) -> np.ndarray:
        """The ``k``-th values, from 0."""
        if self.form == ARRAY:
            return self.values[k].astype(np.int64)
        at = self.before.searchsorted(k, "right") - 1
        inside = k - self.before[at]
        if self.form == RUNS:
            return self.values[at].astype(np.int64) + inside
        return at * 64 + _place_in_word(self.values[at], inside)

    def rank(self, x: np.ndarray) -> np.ndarray:
        """How many values are smaller than each ``x``."""
        if self.form == ARRAY:
            return self.values.searchsorted(x, "left").astype(np.int64)
        if self.form == RUNS:
            at = self.values.searchsorted(x, "right") - 1
            length = np.diff(self.before)
            return np.where(at < 0, 0, self.before[at] + np.minimum(x - self.values[at].astype(np.int64), length[at]))
        word, bit = x >> 6, (x & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.values[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)


class BoundarySet:
    """A set of positions, built from sorted distinct ones."""

    def __init__(self, positions: np.ndarray):
        positions = np.asarray(positions, np.int64)
        high = positions >> 16
        cut = np.flatnonzero(np.concatenate(([True], high[1:] != high[:-1]))) if len(positions) else np.zeros(0, np.int64)
        self.keys = high[cut]
        self.containers = [Container(x & (CONTAINER - 1)) for x in np.split(positions, cut[1:])] if len(cut) else []
        self.before = np.concatenate((cut, [len(positions)]))

    def __len__(self) -> int:
        return int(self.before[-1])

    def _each(self, at: np.ndarray, of: np.ndarray, ask) -> np.ndarray:
        """Answers of ``ask(container, values)`` for the values ``of``, each in container ``at``."""
        out = np.zeros(len(of), np.int64)
        order = np.argsort(at, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
            if len(part):
                out[part] = ask(int(at[part[0]]), of[part])
        return out

    def select(self, k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest positions, from 0."""
        k = np.asarray(k, np.int64)
        at = self.before.searchsorted(k, "right") - 1
        return self._each(at, k - self.before[at], lambda c, x: (self.keys[c] << 16) + self.containers[c].select(x))

    def rank(self, x: np.ndarray) -> np.ndarray:
        """How many positions are smaller than each ``x``."""
        x = np.asarray(x, np.int64)
        if not self.containers:
            return np.zeros(len(x), np.int64)
        at = self.keys.searchsorted(x >> 16, "left")
        here = np.minimum(at, len(self.keys) - 1)
        inside = (at < len(self.keys)) & (self.keys[here] == x >> 16)
        local = np.zeros(len(x), np.int64)
        local[inside] = self._each(here[inside], x[inside] & (CONTAINER - 1), lambda c, v: self.containers[c].rank(v))
        return self.before[at] + local
