"""How lengths are mixed to fill windows: repeat counts by non-negative least squares, then a greedy rest.

All work is on the histogram of lengths, which has one number a length whatever the number of documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def combinations(window: int) -> np.ndarray:
    """All non-decreasing triples of lengths that fill ``window``; 0 stands for no piece, so pairs are among them."""
    first = np.arange(0, window // 3 + 1)
    rows = [np.stack([np.full(k, a), b := np.arange(max(a, 1), max(a, 1) + k), window - a - b], 1) for a in first.tolist() if (k := (window - a) // 2 - max(a, 1) + 1) > 0]
    return np.concatenate(rows)


def solve(mixes: np.ndarray, histogram: np.ndarray, rounds: int) -> np.ndarray:
    """x >= 0 that minimizes |A x - histogram|, where column s of A counts the lengths of mix s.

    Accelerated projected gradient with restarts: A is never built, a product is a few gathers over the mixes.
    """
    size = len(histogram)
    weight = (mixes > 0).astype(float)
    flat = mixes.ravel()
    forward = lambda x: np.bincount(flat, (x[:, None] * weight).ravel(), size)
    backward = lambda r: (r[mixes] * weight).sum(1)
    v = np.ones(len(mixes))
    for _ in range(20):  # the largest eigenvalue of A'A bounds the step
        v = backward(forward(v))
        top = np.linalg.norm(v)
        v /= top
    target = histogram.astype(float)
    x = y = np.zeros(len(mixes))
    t = 1.0
    for _ in range(rounds):
        step = backward(target - forward(y)) / (1.01 * top)
        new = np.maximum(y + step, 0)
        if (step * (new - x)).sum() < 0:
            t = 1.0
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


#: Rounds of the solver, over so many of the largest mixes a length; first over all.
SCHEDULE = ((None, 100), (24, 150), (12, 200), (6, 400), (3, 1000))
#: The largest mixes of each length that stay whatever the others.
EACH = 3


def _largest(mixes: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` mixes of largest x, and the EACH largest with each length."""
    order = np.argsort(-x, kind="stable")
    keep = np.zeros(len(mixes), bool)
    keep[order[:most]] = True
    length, holder = mixes[order].ravel(), np.repeat(order, mixes.shape[1])
    by = np.argsort(length, kind="stable")
    place = np.arange(len(by)) - np.searchsorted(length[by], length[by])
    keep[holder[by][(place < EACH) & (length[by] > 0)]] = True
    return mixes[keep]


def repeat_counts(mixes: np.ndarray, histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mixes and how often each is repeated: solved over all, then over ever fewer, since few large counts round better than many small ones."""
    x = np.zeros(0)
    for most, rounds in SCHEDULE:
        if most:
            mixes = _largest(mixes, x, most * len(histogram))
        x = solve(mixes, histogram, rounds)
    return mixes, x


@dataclass
class Plan:
    """Ranks of each length dealt to places of sequences; the rest stands in a line that is cut into windows.

    Interval i holds the documents of ``length[i]`` with ranks from ``first[i]``: every ``copies[i]`` of them share a
    sequence, numbered on from ``sequence[i]``, and stand from ``offset[i]``. ``copies`` 0: in the line from ``offset[i]``.
    """

    window: int
    length: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    copies: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    mixed: int = 0
    line: int = 0

    def _give(self, taken: np.ndarray, length: int, copies: int, repeats: int, offset: int) -> None:
        self.length.append(length), self.first.append(int(taken[length])), self.copies.append(copies), self.sequence.append(self.mixed), self.offset.append(offset)
        taken[length] += copies * repeats

    def fill(self, taken: np.ndarray, lengths: list[tuple[int, int]], repeats: int) -> None:
        """``repeats`` sequences of (length, copies)."""
        offset = 0
        for length, copies in lengths:
            self._give(taken, length, copies, repeats, offset)
            offset += length * copies
        self.mixed += repeats

    @property
    def line_windows(self) -> int:
        """Sequences of the line: whole windows, and for what is left one for each power of two in its length."""
        return self.line // self.window + (self.line % self.window).bit_count()


def plan(histogram: np.ndarray, window: int) -> Plan:
    """Where the documents of each length go: ``histogram[k]`` has length k, for 0 < k < ``window``."""
    left, taken, out = histogram.astype(np.int64), np.zeros(window, np.int64), Plan(window)
    left[0] = 0
    if left.any():
        mixes, repeats = repeat_counts(combinations(window), left)
        whole = np.floor(repeats + 1e-9).astype(np.int64)
        for at in (order := np.argsort(-repeats, kind="stable"))[whole[order] > 0].tolist():
            parts = [(k, mixes[at].tolist().count(k)) for k in sorted(set(mixes[at].tolist()) - {0}, reverse=True)]
            number = min(int(whole[at]), *(int(left[k]) // m for k, m in parts))
            if number:
                out.fill(taken, parts, number)
                for k, m in parts:
                    left[k] -= m * number
    # what rounding left: the longest first, each time with the longest that still fits; without an exact fit it joins the line
    loose = np.zeros(window, np.int64)
    for length in range(window - 1, 0, -1):
        while left[length]:
            parts, gap, free = [], window, left.copy()
            at = length
            while at and gap:
                m = int(min(free[at], gap // at)) if at != length or parts else 1
                parts.append((at, m))
                free[at] -= m
                gap -= m * at
                fits = np.flatnonzero(free[1 : gap + 1]) + 1 if gap else []
                at = int(fits[-1]) if len(fits) else 0
            if gap:
                loose[length] += left[length]
                left[length] = 0
                break
            total: dict[int, int] = {}
            for k, m in parts:
                total[k] = total.get(k, 0) + m
            number = min(int(left[k]) // m for k, m in total.items())
            out.fill(taken, list(total.items()), number)
            for k, m in total.items():
                left[k] -= m * number
    for length in np.flatnonzero(loose)[::-1].tolist():
        out._give(taken, length, 0, 0, out.line)
        out.line += length * int(loose[length])
    return out
