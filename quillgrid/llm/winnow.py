"""Winnowing: every string of a fixed length is seen at the least of its gram hashes, which equal strings choose alike."""

from __future__ import annotations

import numpy as np

from . import bits


def chosen(gram: np.ndarray, first: np.ndarray, count: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors as (position, first, last start): strings that start in first..last choose this position.

    gram: a hash for each position. Row i has the string starts first[i] ... first[i] + count[i] - 1, each of which
    chooses the leftmost of the least hashes at itself and the window - 1 positions after it.
    """
    at = bits.ranges(first, count)
    if not len(at):
        return at, at, at
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    span = 1
    while span * 2 <= window:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if window > span:
        least = np.minimum(least[: len(least) - (window - span)], least[window - span :])
    pos = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (pos[1:] != pos[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    return pos[head], at[head], at[np.append(head[1:], len(at)) - 1]
