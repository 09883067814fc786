"""64-bit hashing of words and shingles in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S1, _S2 = np.uint64(30), np.uint64(27)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each value; the values differ where the inputs do."""
    x = (x ^ (x >> _S1)) * _A
    x = (x ^ (x >> _S2)) * _B
    return x ^ (x >> np.uint64(31))


def mix1(x: np.ndarray) -> np.ndarray:
    """A second such function, independent of the first."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes:
    """Words (bytes) -> hashes. None is remembered: that takes longer than to hash a word."""

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
