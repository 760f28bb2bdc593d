"""Forward-backward of linear-chain conditional random fields for many sequences at once.

Sequences are cut into segments of SEGMENT positions. Segments' transfer matrices are multiplied side by side, a
scan over them gives each segment's messages from outside, and all segments then finish side by side. The
result is that of the plain recursion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SEGMENT = 32
#: Positions of a single long sequence that are finished together.
RUN = 1 << 16


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-300)


def forward_backward(
    emissions: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, start: np.ndarray, *, pairs: bool = False, before: np.ndarray | None = None, behind: np.ndarray | None = None
):
    """Label probabilities of each position, and with ``pairs`` also the expected transitions and first labels.

    ``emissions`` is (positions, labels), the sequences of ``sizes`` (all above 0) one after another; scores are
    logarithms. A sequence that is part of a longer one takes the messages from what lies ``before`` and
    ``behind`` it; there is then only that one.
    """
    n, k = emissions.shape
    a = np.exp(transitions - transitions.max()).astype(np.float64)
    first = np.exp(start - start.max()).astype(np.float64)
    e = np.exp(emissions - emissions.max(axis=1, keepdims=True)).astype(np.float64)
    segments = -(-sizes // SEGMENT)
    of = np.repeat(np.arange(len(sizes)), segments)
    head = np.cumsum(segments) - segments
    nth = np.arange(len(of)) - head[of]
    begin = (np.cumsum(sizes) - sizes)[of] + nth * SEGMENT
    length = np.minimum(SEGMENT, sizes[of] - nth * SEGMENT)
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    place = np.empty(len(of), np.int64)
    place[order] = np.arange(len(of))
    is_first = np.empty(len(of), bool)
    is_first[place] = (nth == 0) & (before is None)
    if before is not None:
        first = before
    longest = int(length.max())
    running = np.searchsorted(-length, -np.arange(longest), side="left")

    inward = np.ones((len(of), k))  # message from the left, before the segment's first transition
    outward = np.ones((len(of), k))  # message from the right, after its last position
    if before is not None:
        inward[place[0]] = before
    if behind is not None:
        outward[place[-1]] = behind
    more = np.flatnonzero(segments > 1)
    if len(more):
        lanes = np.flatnonzero(~is_first | (segments[of][order] > 1))  # in order of falling length
        m = np.broadcast_to(np.eye(k), (len(lanes), k, k)).copy()
        for t in range(longest):
            c = int(np.searchsorted(-length[lanes], -t, side="left"))
            step = m[:c] @ a
            if t == 0:  # a sequence's first position has no transition
                step[is_first[lanes[:c]]] = m[:c][is_first[lanes[:c]]]
            step *= e[begin[lanes[:c]] + t][:, None, :]
            m[:c] = step / np.maximum(step.sum(axis=(1, 2), keepdims=True), 1e-300)
        whole = np.empty(len(of), np.int64)
        whole[lanes] = np.arange(len(lanes))
        more = more[np.argsort(-segments[more], kind="stable")]
        count = segments[more]
        v = np.broadcast_to(first, (len(more), k)).copy()
        for s in range(int(count.max()) - 1):
            c = int(np.searchsorted(-count, -(s + 1), side="left"))
            at = place[head[more[:c]] + s]
            v[:c] = _normal((v[:c, None, :] @ m[whole[at]])[:, 0])
            inward[place[head[more[:c]] + s + 1]] = v[:c]
        v = np.ones((len(more), k)) if behind is None else behind[None, :].copy()
        for s in range(int(count.max()) - 1, 0, -1):
            c = int(np.searchsorted(-count, -s, side="left"))
            at = place[head[more[:c]] + s]
            v[:c] = _normal((m[whole[at]] @ v[:c, :, None])[:, :, 0])
            outward[place[head[more[:c]] + s - 1]] = v[:c]
    forward = np.empty((longest, len(of), k))
    v = inward.copy()
    for t in range(longest):
        c = int(running[t])
        step = v[:c] @ a
        if t == 0:
            step[is_first] = first
        v[:c] = forward[t, :c] = _normal(step * e[begin[:c] + t])
    out = np.empty((n, k))
    v = outward.copy()
    expected = np.zeros((k, k))
    for t in range(longest - 1, -1, -1):
        c = int(running[t])
        at = begin[:c] + t
        out[at] = _normal(forward[t, :c] * v[:c])
        right = e[at] * v[:c]
        if pairs:
            left = forward[t - 1, :c] if t else inward[:c]
            both = left[:, :, None] * a * right[:, None, :]
            both /= np.maximum(both.sum(axis=(1, 2), keepdims=True), 1e-300)
            expected += both.sum(axis=0) if t else both[~is_first[:c]].sum(axis=0)
        v[:c] = _normal(right @ a.T)
    if not pairs:
        return out
    return out, expected, out[np.cumsum(sizes) - sizes].sum(axis=0)


def _transfer(emissions: np.ndarray, transitions: np.ndarray, start: np.ndarray | None) -> np.ndarray:
    """The product of all steps of a run, scaled; its first step comes from ``start`` where that is given."""
    e = np.exp(emissions - emissions.max(axis=1, keepdims=True)).astype(np.float64)
    m = np.exp(transitions - transitions.max())[None] * e[:, None, :]
    if start is not None:
        m[0] = np.exp(start - start.max())[None, :] * e[0][None, :]
    while len(m) > 1:
        even = m[0 : len(m) - len(m) % 2 : 2] @ m[1::2]
        m = np.concatenate([even, m[-1:]]) if len(m) % 2 else even
        m /= np.maximum(m.sum(axis=(1, 2), keepdims=True), 1e-300)
    return m[0]


def runs_of_long(emissions: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Label probabilities of one sequence as (first, past the last, probabilities) of runs of RUN positions.

    Messages between runs come from the runs' transfer matrices, so working memory is that of one run.
    """
    cuts = [*range(0, len(emissions), RUN), len(emissions)]
    spans = [*zip(cuts, cuts[1:], strict=False)]
    moves = [_transfer(emissions[a:b], transitions, start if a == 0 else None) for a, b in spans]
    k = emissions.shape[1]
    left = [None]
    for m in moves[:-1]:
        left.append(_normal((np.ones(k) if left[-1] is None else left[-1]) @ m))
    right = [None] * len(spans)
    for i in range(len(spans) - 2, -1, -1):
        right[i] = _normal(moves[i + 1] @ (np.ones(k) if right[i + 1] is None else right[i + 1]))
    for (a, b), before, behind in zip(spans, left, right, strict=True):
        yield a, b, forward_backward(emissions[a:b], np.array([b - a]), transitions, start, before=before, behind=behind)


def mean_of_long(emissions: np.ndarray, weights: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Label probabilities of one sequence, averaged by ``weights``."""
    total = np.zeros(emissions.shape[1])
    for a, b, p in runs_of_long(emissions, transitions, start):
        total += weights[a:b] @ p
    return total / weights.sum()


class Adagrad:
    def __init__(self, *arrays: np.ndarray, rate: float):
        self.arrays, self.rate = arrays, rate
        self.seen = [np.full_like(x, 1e-8) for x in arrays]

    def climb(self, *gradients: np.ndarray) -> None:
        for x, s, g in zip(self.arrays, self.seen, gradients, strict=True):
            s += g * g
            x += self.rate * g / np.sqrt(s)
