"""Words and lines of byte strings as ranges, and hashes of the ranges; memory beside the ranges stays bounded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes looked at together.
STRETCH = 1 << 20


def ranges(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last positions of the runs where ``inside`` holds; both ends must be outside."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edge[::2], edge[1::2]


def stretches(size: int, stretch: int = STRETCH) -> Iterator[tuple[int, int]]:
    for at in range(0, size, stretch):
        yield at, min(size, at + stretch)


def hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, base: int, *, add: int = 0) -> np.ndarray:
    """Polynomial hash modulo 2**64 of each range of ``data``: the sum of (byte + add) * base**(position in the range).

    Ranges are disjoint and ascending; they may be empty. The running sum and the powers are held only where a
    range begins or ends, so a text of any length takes one stretch of working memory.
    """
    back = pow(base, -1, 1 << 64)
    at_first, at_last = np.zeros(len(first), np.uint64), np.zeros(len(last), np.uint64)
    undo = np.ones(len(first), np.uint64)
    total, up, down = 0, 1, 1
    for a, b in [*stretches(len(data))] or [(0, 0)]:
        part = data[a:b].astype(np.uint64) + np.uint64(add)
        n = len(part)
        power = np.full(n + 1, base, np.uint64)
        power[0] = up
        power = np.cumprod(power, dtype=np.uint64)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = total
        np.cumsum(part * power[:-1], dtype=np.uint64, out=sums[1:])
        sums[1:] += np.uint64(total)
        lo, hi = np.searchsorted(first, (a, b))
        inverse = np.full(n + 1, back, np.uint64)
        inverse[0] = down
        inverse = np.cumprod(inverse, dtype=np.uint64)
        at_first[lo:hi], undo[lo:hi] = sums[first[lo:hi] - a], inverse[first[lo:hi] - a]
        lo, hi = np.searchsorted(last, (a, b), side="right")  # ends after a, up to b
        at_last[lo:hi] = sums[last[lo:hi] - a]
        total, up, down = int(sums[-1]), int(power[-1]), int(inverse[-1])
    return (at_last - at_first) * undo


def per_range(values: np.ndarray, begin: int, starts: np.ndarray, out: np.ndarray) -> None:
    """Add ``values``, which belong to the positions from ``begin`` on, to the rows of ``out``.

    Row i owns the positions from starts[i] up to starts[i + 1], the last row all that follow; what lies before
    the first start belongs to none.
    """
    end = begin + len(values)
    lo, hi = np.searchsorted(starts, (begin, end))
    if lo and (hi == lo or starts[lo] > begin):  # a row begun earlier goes on
        stop = (int(starts[lo]) if lo < hi else end) - begin
        out[lo - 1] += values[:stop].sum(axis=0)
    if hi > lo:
        out[lo:hi] += np.add.reduceat(values, starts[lo:hi] - begin, axis=0)
