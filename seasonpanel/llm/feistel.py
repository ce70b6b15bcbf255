"""A keyed permutation of 0 .. n-1 without any table: Feistel rounds with cycle-walking."""

from __future__ import annotations

import numpy as np

ROUNDS = 6
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _once(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for key in keys:
        left, right = right, left ^ (_mix(right + key) & mask)
    return (left << np.uint64(half)) | right


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Places of ``x`` (values in 0 .. n-1) under the permutation that ``key`` selects.

    The rounds permute the next even power of two, at most 4 n; a value that lands outside is
    sent through again until it is inside, which keeps the map one to one.
    """
    if n >= 1 << 62:
        raise ValueError("n must be below 2**62")
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % (1 << 64)))
    out = _once(np.asarray(x, np.uint64), half, keys)
    outside = np.flatnonzero(out >= n)
    while len(outside):
        out[outside] = _once(out[outside], half, keys)
        outside = outside[out[outside] >= n]
    return out.astype(np.int64)
