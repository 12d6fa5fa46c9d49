"""Order statistics over stretches of a sequence, for all questions at once in log time each (a wavelet matrix)."""

from __future__ import annotations

import numpy as np


class Ranks:
    """Counts and order statistics over stretches [lo, hi) of a sequence of values without nulls.

    Values are kept as ranks, bit by bit from the highest; at each bit the sequence is parted stably into zeros and ones, so a
    stretch stays a stretch. A question walks the bits once; questions are arrays, answered together.
    """

    def __init__(self, values: np.ndarray):
        self.values, ranks = np.unique(values, return_inverse=True)
        self.bits = max(1, int(len(self.values)).bit_length())
        self.zeros = []  # for each bit the zeros before each place
        for bit in range(self.bits - 1, -1, -1):
            on = (ranks >> bit) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~on)]))
            ranks = np.concatenate([ranks[~on], ranks[on]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, equal: bool = False) -> np.ndarray:
        """How many of each stretch are less than x (or equal to it)."""
        rank = np.searchsorted(self.values, x, "right" if equal else "left")
        lo, hi, out = lo.copy(), hi.copy(), np.zeros(len(lo), np.int64)
        for level, zeros in enumerate(self.zeros):
            on = (rank >> (self.bits - 1 - level)) & 1 == 1
            a, b = zeros[lo], zeros[hi]
            out += np.where(on, b - a, 0)
            lo, hi = np.where(on, zeros[-1] + lo - a, a), np.where(on, zeros[-1] + hi - b, b)
        return out

    def kth(self, stretches: list[tuple[np.ndarray, np.ndarray]], k: np.ndarray) -> np.ndarray:
        """The value of place k, from 0, among those of several stretches in order; places must be there."""
        stretches, k, rank = [(lo.copy(), hi.copy()) for lo, hi in stretches], k.copy(), np.zeros(len(k), np.int64)
        for level, zeros in enumerate(self.zeros):
            ends = [(lo, hi, zeros[lo], zeros[hi]) for lo, hi in stretches]
            count = sum(b - a for *_, a, b in ends)
            on = k >= count
            k = np.where(on, k - count, k)
            rank |= on.astype(np.int64) << (self.bits - 1 - level)
            stretches = [(np.where(on, zeros[-1] + lo - a, a), np.where(on, zeros[-1] + hi - b, b)) for lo, hi, a, b in ends]
        return self.values[np.minimum(rank, len(self.values) - 1)]


def rises(values: np.ndarray) -> int:
    """Pairs of a sequence that rise less those that fall, in n log n."""
    n = len(values)
    if n < 2:
        return 0
    start, at, ranks = np.zeros(n, np.int64), np.arange(n), Ranks(values)
    return int((ranks.below(start, at, values) - (at - ranks.below(start, at, values, equal=True))).sum())
