"""Hashes of words and of runs of words, as 64-bit numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words, from the words' hashes; none if there are fewer.

    Doubling: runs of 2m words come from two runs of m, runs of n from two that overlap.
    """
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h, m = words, 1
    while m < n:
        step = min(m, n - m)
        h = mixed(h[: len(h) - step] * _ODD + h[step:])
        m += step
    return h


def shingle_set(text: str | bytes | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; with fewer words, the whole sequence as one.

    Words are what ASCII white space parts, with A-Z in lower case.
    """
    data = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    return np.unique(run_hashes(h, n) if len(h) >= n else run_hashes(h, len(h)))
