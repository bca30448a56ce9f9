"""Bidirectional FM-index over the word ids of one shard, for phrases of at most ``DEPTH`` words.

Positions are ordered by the ``DEPTH`` ids that begin there, so every phrase up to that length is an interval.
The transform holds the id before each ordered position. A step to the left of many disjoint intervals groups their part of the transform by
(interval, id): the first position of a group leads through the LF mapping to the new interval, its size is
the count, and the number of smaller ids in the interval moves the interval of the reversed text. A step to the
right is the same over the transform of the reversed text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEPTH = 5


def _dense(key: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of values among the distinct ones, and how many of these there are."""
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    new = np.zeros(len(key), np.int32)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(len(key), np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32)
    return rank, int(new.sum()) + 1


def transform(ids: np.ndarray, n_ids: int) -> np.ndarray:
    """Burrows-Wheeler transform of a cyclic text of ids below ``n_ids``, ordered by ``DEPTH`` ids."""
    two, n_two = _dense(ids.astype(np.int64) * n_ids + np.roll(ids, -1))
    four, _ = _dense(two.astype(np.int64) * n_two + np.roll(two, -2))
    order = np.argsort(four.astype(np.int64) * n_ids + np.roll(ids, 1 - DEPTH), kind="stable")
    return ids[order - 1]


@dataclass(frozen=True)
class Steps:
    """New intervals of one step: the interval each comes from, its id, place, count, and place in the other direction."""

    of: np.ndarray
    id: np.ndarray
    low: np.ndarray
    count: np.ndarray
    other: np.ndarray


class Direction:
    """One transform with its LF mapping."""

    def __init__(self, bwt: np.ndarray, n_ids: int):
        self.bwt, self.n_ids = bwt, n_ids
        self.lf = np.empty(len(bwt), np.int32)
        self.lf[np.argsort(bwt, kind="stable")] = np.arange(len(bwt), dtype=np.int32)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(bwt, minlength=n_ids))))

    def extend(self, low: np.ndarray, count: np.ndarray, other: np.ndarray) -> Steps:
        """All one-id extensions of disjoint intervals, sorted by interval and id; id 0 parts texts and is left out."""
        total = np.cumsum(count)
        at = np.repeat(low - total + count, count) + np.arange(total[-1] if len(total) else 0)
        of = np.repeat(np.arange(len(low)), count)
        key = of * self.n_ids + self.bwt[at]
        del of
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        size = np.diff(np.append(new, len(key)))
        of, id_ = key[new] // self.n_ids, key[new] % self.n_ids
        # Intervals are gathered one behind the other: what lies before a group in its interval has a smaller id.
        smaller = new - (total - count)[of] if len(new) else new
        real = id_ > 0
        return Steps(of[real], id_[real], self.lf[at[order[new[real]]]], size[real], other[of[real]] + smaller[real])


def words(direction: Direction) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of the single ids from 1 on: the same in both directions."""
    return direction.first[1:-1], np.diff(direction.first)[1:]
