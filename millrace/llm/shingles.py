"""64-bit hashes of words and word shingles, a whole text at a time in numpy."""

from __future__ import annotations

import numpy as np

_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9FB21C651E98DF25 | 1
_STEP = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20))
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as the longest text so far needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE, np.uint64)])
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, pow(_BASE, -1, 1 << 64), np.uint64)])
        return self.up[:n], self.down[:n]


_powers = _Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def sums(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums for ``pieces``: any byte range's hash is a difference of two of them times a power."""
    data = np.frombuffer(text, np.uint8)
    up, down = _powers.upto(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[:-1], out=total[1:])
    return total, down


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of every word (run of bytes that are no white space)."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~_WHITE[np.frombuffer(text, np.uint8)]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total, down = sums(text)
    with np.errstate(over="ignore"):
        return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _STEP)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; a shorter text is one run."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(size, len(words))
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(width), np.uint64)
        for k in range(width):
            out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + words[k:k + n])
    return np.unique(out)
