"""Word shingles as sorted arrays of 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from tidemark.llm.common import text_words

WIDTH = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: list[bytes]) -> np.ndarray:
    """A hash for each five-word window in order; fewer words make one shingle of the whole sequence; none make none."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - WIDTH + 1
    total = h[:n] * _ODD[0]
    for k in range(1, WIDTH):
        total = total + h[k : n + k] * _ODD[k]
    return mix(total)


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(window_hashes(text_words(text)))
