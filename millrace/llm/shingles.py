"""Words and word shingles of whole texts, as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class WordHashes(dict):
    """Hash of a word (bytes), kept for words met before up to a bound."""

    def __init__(self, most: int = 300_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, text: str | None) -> np.ndarray:
        """One hash per word, in order. A-Z are lowered; words are split at ASCII white space, which
        is what bytes.split and bytes.lower do."""
        words = text.encode().lower().split() if text else []
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_set(words: np.ndarray, size: int = 5) -> np.ndarray:
    """The distinct shingles' hashes, ascending; with fewer words than size, the whole sequence is
    the only one; without words the set is empty."""
    if not len(words):
        return words
    k = min(size, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = out * _MIX[0] + words[i : len(words) - k + 1 + i]
    out ^= out >> np.uint64(30)
    out *= _MIX[1]
    out ^= out >> np.uint64(27)
    out *= _MIX[2]
    out ^= out >> np.uint64(31)
    return np.unique(out)
