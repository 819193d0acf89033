"""Small numpy helpers for pairs inside blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def run_bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values in a sorted array."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.nonzero(keys[1:] != keys[:-1])[0] + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])


def pairs_in_runs(starts: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every two places of each run, once, some `most` pairs at a time (one row's pairs are never cut)."""
    size = ends - starts
    starts, size = starts[size > 1], size[size > 1]
    if not len(size):
        return
    first = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(starts, size) + first
    later = np.repeat(size, size) - first - 1
    at, later = at[later > 0], later[later > 0]
    total = np.cumsum(later)
    low = 0
    while low < len(at):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + most, side="right")))
        n = later[low:high]
        a = np.repeat(at[low:high], n)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        low = high


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least place linked with each of `n` places, over any number of links."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label
