"""Word shingles as 64-bit hashes, worked out in numpy inside Spark's Python workers."""

from __future__ import annotations

import numpy as np
import xxhash

#: Fixed odd multipliers of the shingle hash.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


class Hashes(dict):
    """Hash of a word, kept for the next time; it starts anew when it holds too many."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = x = xxhash.xxh3_64_intdigest(word)
        return x


def words(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of text after lower-casing A-Z; null has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word shingles in order of place; fewer than k words count as one shingle, none as none."""
    if len(hashes) == 0:
        return hashes
    n = max(1, len(hashes) - k + 1)
    width = min(k, len(hashes))
    x = np.full(n, width, dtype=np.uint64)
    for j in range(width):
        x = (x ^ hashes[j : j + n]) * _MIX[j % len(_MIX)]
        x ^= x >> np.uint64(32)
    return mixed(x)


def shingle_set(text: str | None, k: int, cache: Hashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    w = words(text)
    return np.unique(shingles(np.fromiter(map(cache.__getitem__, w), np.uint64, len(w)), k))
