"""Rolling hashes of code points: the hash of any stretch of an array from prefix sums."""

from __future__ import annotations

import functools

import numpy as np

_MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: The inverse of STEP.
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit numbers."""
    x = (x + np.uint64(1)) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@functools.cache
def points() -> np.ndarray:
    """A number for each code point."""
    return mixed(np.arange(0x110000, dtype=np.uint64))


_powers: list[np.ndarray] = [np.zeros(0, np.uint64)] * 2


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP and its inverse to the powers 0 .. n - 1."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, x in enumerate((STEP, BACK)):
            row = np.full(size, x, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row)
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, forth): codes[a:b] has the hash (sums[b] - sums[a]) * forth[b - 1], wherever it lies."""
    forth, back = powers(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(points()[codes] * back, out=sums[1:])
    return sums, forth


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def stretches(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)
