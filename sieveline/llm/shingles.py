"""Hashed word shingles of whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
_K = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x moves every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[str]:
    """Lower-case words between white space."""
    return (text or "").lower().split()


def shingle_hashes(tokens: list[str], size: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of each window of `size` words, in order; a shorter text is one shingle, one without words none."""
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    size = min(size, n)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, n)
    out = h[: n - size + 1].copy()
    for k in range(1, size):
        out = out * _K + h[k : n - size + 1 + k]
    return mix(out + np.uint64(size))
