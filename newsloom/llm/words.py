"""Words of stored texts and their hashes, the same in every worker."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A word: a longest run of letters or digits (classes L and N) of the lower-cased text.
find_words = re.compile(r"[^\W_]+").findall
_MEMO = 400_000


class WordHashes(dict):
    """word -> 64-bit hash, remembered; forgets all when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
