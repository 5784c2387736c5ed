"""Suffix arrays by Larsson-Sadakane refinement, common prefixes, and merging by binary search, in numpy."""

from __future__ import annotations

import numpy as np


def packed(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number in byte order; zeros behind the end."""
    x = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        x = (x[:-width] << np.uint64(8 * width)) | x[width:]
    return x[: len(data)]


def suffix_array(data: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffixes of data in order, compared by their first ``depth`` bytes at least (all, if None); what is equal that far
    is in no particular order.  The first sort takes 8 bytes; each round doubles the depth and touches only groups that
    aren't settled.  A suffix that ends within the compared bytes stands before those that go on."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    first = packed(data)
    order = np.argsort(first, kind="stable")
    group = np.empty(n, np.int64)
    sorted_keys = first[order]
    tail = np.minimum(n - order, 8)  # tells zeros behind the end from zero bytes
    new = np.empty(n, bool)
    new[0] = True
    same = sorted_keys[1:] == sorted_keys[:-1]
    short = np.flatnonzero(tail < 8)
    if len(short):
        fix = np.lexsort((tail, sorted_keys))
        order, sorted_keys, tail = order[fix], sorted_keys[fix], tail[fix]
        same = (sorted_keys[1:] == sorted_keys[:-1]) & (tail[1:] == tail[:-1])
    new[1:] = ~same
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, n))
    group[order] = np.repeat(heads, sizes)
    h = 8
    while True:
        loose = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places in order that aren't settled
        if not len(loose) or (depth is not None and h >= depth):
            return order
        at = order[loose]
        after = np.where(at + h < n, group[np.minimum(at + h, n - 1)] + 1, 0)
        own = group[at]
        move = np.argsort(own.astype(np.uint64) * np.uint64(n + 1) + after.astype(np.uint64), kind="stable") if n < (1 << 32) - 1 else np.lexsort((after, own))
        at, own, after = at[move], own[move], after[move]
        order[loose] = at
        fresh = np.empty(len(at), bool)
        fresh[0] = True
        fresh[1:] = (own[1:] != own[:-1]) | (after[1:] != after[:-1])
        new[loose] = fresh
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, n))
        group[order] = np.repeat(heads, sizes)
        h *= 2


def kasai(data: bytes, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix in order with the one before it (0 for the first).  A loop over bytes: for small
    inputs and as the yardstick for ``common_at_least``."""
    n = len(data)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    out, h = np.zeros(n, np.int64), 0
    for i in range(n):
        if rank[i] == 0:
            h = 0
            continue
        j = int(order[rank[i] - 1])
        while i + h < n and j + h < n and data[i + h] == data[j + h]:
            h += 1
        out[rank[i]] = h
        h = max(0, h - 1)
    return out


def common_at_least(first: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes from a and from b are equal; first: packed(data).  All positions at once, eight bytes a
    step, and only those that are equal so far."""
    equal = np.ones(len(a), bool)
    left = np.arange(len(a))
    for step in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        ok = first[a[left] + step] == first[b[left] + step]
        equal[left[~ok]] = False
        left = left[ok]
    return equal


class WindowShard:
    """The distinct windows of a shard in order, each with the least owner; found again by binary search."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, owners: np.ndarray, length: int):
        """starts: window starts in ascending order; owners[i]: the document of starts[i].  Sets ``least``: for each start
        the least owner of an equal window in this shard."""
        self.length = length
        chosen = np.zeros(len(data), bool)
        chosen[starts] = True
        order = suffix_array(data, length)
        order = order[chosen[order]]
        first = packed(data)
        new = np.ones(len(order), bool)
        if len(order) > 1:
            new[1:] = ~common_at_least(first, order[1:], order[:-1], length)
        place = np.zeros(len(data), np.int64)
        place[starts] = np.arange(len(starts))
        own = owners[place[order]]
        heads = np.flatnonzero(new)
        self.lows = np.minimum.reduceat(own, heads) if len(heads) else own
        self.least = np.empty(len(starts), own.dtype)
        self.least[place[order]] = np.repeat(self.lows, np.diff(np.append(heads, len(order))))
        self._heads, self._data = order[heads], data
        self._windows: np.ndarray | None = None

    def windows(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, self.length)[starts]).view(f"S{self.length}").ravel()

    def find(self, data: np.ndarray, starts: np.ndarray, none: int) -> np.ndarray:
        """The least owner of the window at each start in this shard, ``none`` where it has no such window."""
        if not len(self._heads) or not len(starts):
            return np.full(len(starts), none)
        if self._windows is None:
            self._windows = self.windows(self._data, self._heads)
        asked = self.windows(data, starts)
        at = np.minimum(np.searchsorted(self._windows, asked), len(self._windows) - 1)
        return np.where(self._windows[at] == asked, self.lows[at], none)
