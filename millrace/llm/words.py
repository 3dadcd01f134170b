"""Words, word hashes and shingles, shared by the text operators.

A word is a maximal run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased.
All separators are ASCII, so the split can run on UTF-8 bytes.
"""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5

_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def words(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8; none for a null or empty text."""
    return text.encode("utf-8").translate(_TABLE).split() if text else []


class WordHashes(dict):
    """64-bit hash of each word, remembered for at most ``bound`` different words."""

    def __init__(self, bound: int = 300_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words, in order; empty if there are fewer words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:count].copy()
    for i in range(1, n):
        total *= _ODD
        total += hashes[i : i + count]
    return mix(total)


def shingle_hashes(hashes: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``n`` words; a text of fewer words, but not none, is one shingle."""
    return ngram_hashes(hashes, min(n, len(hashes))) if len(hashes) else np.empty(0, np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of different values; 0 if both are empty."""
    if not len(a) or not len(b):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)
