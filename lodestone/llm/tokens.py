"""Words as 64-bit hashes, and 5-word shingle sets."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered up to a bound."""

    def __init__(self, bound: int = 300_000) -> None:
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at the ASCII white space 0x20 and 0x09-0x0D: just what bytes.lower and bytes.split do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer, so that near values spread over 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of width words."""
    n = len(hashes) - width + 1
    total = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(width):
        if n > 0:
            total = total * _STEP + mixed(hashes[j : j + n] + np.uint64(j))
    return mixed(total)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """The sorted set of 5-word shingles; the whole sequence as one where there are fewer words; empty without words."""
    if not len(hashes):
        return hashes
    if len(hashes) < WIDTH:
        return runs(np.append(hashes, np.uint64(len(hashes))), len(hashes) + 1)
    return np.unique(runs(hashes, WIDTH))
