"""Words and word shingles of a text as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from forewarn.llm.common import forget_after

REMEMBERED = 200_000
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """Remembered hashes of words; the caller empties it between texts."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()
forget_after(_HASHES.clear)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return (text or "").encode().lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_HASHES) > REMEMBERED:
        _HASHES.clear()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``size`` words; a shorter text is one shingle, no words are none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    hashes = word_hashes(words)
    width = min(size, len(words))
    n = len(words) - width + 1
    joined = np.full(n, width, np.uint64)
    for i in range(width):
        joined = mixed(joined * _STEP + hashes[i : i + n])
    return np.unique(joined)
