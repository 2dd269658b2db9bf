"""Word shingles of texts as sorted 64-bit hashes, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE_WORDS = 200_000
STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """Hashes of words, kept within a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over the whole number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes], known: WordHash) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on."""
    n = len(hashes) - k + 1
    total = hashes[:n].copy()
    for i in range(1, k):
        total = total * STEP + hashes[i : i + n]
    return mixed(total)


def shingle_set(text: str | None, k: int, known: WordHash) -> np.ndarray:
    """Distinct k-word shingles of a text, A-Z in lower case, split at ASCII white space.

    Fewer than k words make one shingle, no words none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = word_hashes(words, known)
    if len(words) < k:
        return mixed(runs(hashes, len(words)) + np.uint64(len(words)))
    return np.unique(runs(hashes, k))
