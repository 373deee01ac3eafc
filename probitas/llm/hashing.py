"""Hashes of words and windows over NumPy arrays; everything is content-determined and vectorised."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
WORD_BASE = U(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: One 64-bit value per byte; the folded table gives A-Z the values of a-z.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[9, 10, 11, 12, 13, 32]] = True


class Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as far as the longest text asks."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 14)
            self.up = np.concatenate([[U(1)], np.cumprod(np.full(size - 1, BASE))])
            self.down = np.concatenate([[U(1)], np.cumprod(np.full(size - 1, BASE_INVERSE))])
        return self.up[:n], self.down[:n]


POWERS = Powers()


def word_hashes(data: bytes, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word of ``data`` (runs of bytes that are not blank): its 64-bit hash, first byte, end byte."""
    a = np.frombuffer(data, np.uint8)
    blank = np.ones(len(a) + 2, bool)
    blank[1:-1] = IS_BLANK[a]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    first, end = edge[::2], edge[1::2]
    if not len(first):
        return np.empty(0, np.uint64), first, end
    up, down = POWERS.upto(len(a) + 1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((FOLDED_VALUES if fold else BYTE_VALUES)[a] * up[: len(a)], out=total[1:])
    return mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64) * WORD_BASE), first, end


def window_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` values, by doubling: H[a+b](i) = H[a](i) * base**b + H[b](i + a)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, length, done, out = values.astype(np.uint64, copy=False), 1, 0, None
    base = int(WORD_BASE)
    while True:
        if k & length:
            if out is None:
                out, done = power, length
            else:
                m = len(values) - (done + length) + 1
                out = out[:m] * U(pow(base, length, 1 << 64)) + power[done : done + m]
                done += length
        if done == k:
            return mix(out[:n])
        m = len(values) - 2 * length + 1
        power = power[:m] * U(pow(base, length, 1 << 64)) + power[length : length + m]
        length *= 2


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: -(w - size)], values[w - size :]) if w > size else values


def sliding_max(values: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        values = np.maximum(values[:-size], values[size:])
        size *= 2
    return np.maximum(values[: -(w - size)], values[w - size :]) if w > size else values


def minimizers(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest hash of each window of ``w`` hashes, and the positions that are smallest in some window.

    Which positions of a window are chosen depends on the window's content alone, so equal windows choose
    equal places.
    """
    if len(h) < w:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    low = sliding_min(h, w)
    padded = np.zeros(len(h) + w - 1, np.uint64)
    padded[w - 1 : w - 1 + len(low)] = low
    return low, np.flatnonzero(sliding_max(padded, w) == h)


def anchor_of_windows(h: np.ndarray, low: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """For each window: the index in ``chosen`` of its leftmost smallest position."""
    at = np.searchsorted(chosen, np.arange(len(low)))
    wrong = np.flatnonzero(h[chosen[at]] != low)
    while len(wrong):
        at[wrong] += 1
        wrong = wrong[h[chosen[at[wrong]]] != low[wrong]]
    return at


def covered(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending starts of windows to the maximal runs [first, end) that they cover together."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > width)
    return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + width
