"""Vectorised hashing of words and shingles, for the operators that run in Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

_P1, _P2, _P3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


#: Words that a worker remembers at most; frequent ones are soon there again.
WORDS = 100_000


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, remembered; emptied at WORDS words (some 20 MB a worker), so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _P2
    x ^= x >> np.uint64(29)
    x *= _P3
    return x ^ (x >> np.uint64(32))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words; of fewer words, one for the whole sequence; of none, none."""
    n = len(h)
    if not n:
        return h
    k = min(k, n)
    acc = np.full(n - k + 1, k, dtype=np.uint64)
    for j in range(k):
        acc = (acc ^ (acc >> np.uint64(31))) * _P1 + h[j : n - k + 1 + j]
    return scramble(acc)
