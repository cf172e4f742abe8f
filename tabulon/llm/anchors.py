"""Anchors: places of a text that its content picks, one in each window of a given length.

The anchor of a window is its first k-gram of least hash. Equal windows have equal anchors at equal
places, wherever they stand, and each window has just one; so every window belongs to one anchor,
and all windows that are equal belong to anchors of equal hash.
"""

from __future__ import annotations

import numpy as np

from tabulon.llm.common import Rolling

GRAM = 32
BIG = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i : i + w] for each i, by running minima of blocks from both ends."""
    n = len(x) - w + 1
    full = np.full(-(-len(x) // w) * w + w, BIG, np.uint64)
    full[: len(x)] = x
    grid = full.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, k: int = GRAM):
    """(text, first window, last window, hash) arrays: runs of windows of one anchor.

    Windows are given by their start within their text."""
    w = window - k + 1
    none = np.empty(0, np.int64)
    if len(data) < window:
        return none, none, none, np.empty(0, np.uint64)
    grams = Rolling(data).grams(k)
    least = sliding_min(grams, w)
    n = len(least)
    sizes = np.diff(offsets)
    count = np.maximum(0, sizes - window + 1)  # windows of each text
    if not count.sum():
        return none, none, none, np.empty(0, np.uint64)
    valid = np.zeros(n + 1, np.int32)
    has = count > 0
    np.add.at(valid, offsets[:-1][has], 1)
    np.add.at(valid, (offsets[:-1] + count)[has], -1)
    inside = np.cumsum(valid[:-1]) > 0
    # The first place at or after each window start whose hash is the window's least one: a run of
    # windows shares an anchor until that place is passed or a smaller hash comes in.
    begin = inside & np.concatenate([[True], (least[1:] != least[:-1]) | ~inside[:-1]])
    begin[offsets[:-1][has]] = True
    # Within a run of equal minima, the anchor moves on when its own place is passed.
    left = np.concatenate([[False], grams[: n - 1] == least[: n - 1]])
    start = np.flatnonzero(begin | (left & inside))
    stop = np.concatenate([start[1:], [n]])
    text = np.searchsorted(offsets, start, side="right") - 1
    last = np.minimum(stop, (offsets[:-1] + count)[text]) - 1
    return text, start - offsets[text], last - offsets[text], least[start]
