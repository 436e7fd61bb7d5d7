"""Words of UTF-8 texts, hashed all at once."""

from __future__ import annotations

import numpy as np

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_INSIDE = np.array([b not in (9, 10, 11, 12, 13, 32) for b in range(256)])


class Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, as many as the longest text so far needs."""

    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def hashed_words(data: np.ndarray, values: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(where each word starts, its hash). data: bytes; values: a number over 0 for each byte, alike for bytes that count as equal.

    A word is a maximal run without ASCII white space. Its hash is a difference of running sums over all bytes.
    """
    inside = np.concatenate(([False], _INSIDE[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    up, down = powers.upto(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[data] * up)))
    return starts, mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
