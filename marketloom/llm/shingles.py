"""Word shingles as 64-bit hashes: the text layer shared by the near-duplicate operators.

A document's words are the runs of characters outside ``[\\x20\\x09-\\x0D]`` after A-Z are
lower-cased.  Its set holds the hashes of its distinct five-word shingles; a text of one to four
words has its whole word sequence as the only element; a null, empty or blank text has none.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .memo import claim

WIDTH = 5
#: Words remembered per Python worker; the memo is emptied when it is full, so memory stays bounded.
MEMO_WORDS = 200_000
_MULTIPLIERS = np.array(
    [xxhash.xxh3_64_intdigest(b"shingle position %d" % i) | 1 for i in range(WIDTH)], np.uint64
)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct uint64 shingle hashes of one text."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    claim(_words)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if n < WIDTH:
        total = np.uint64(n)
        with np.errstate(over="ignore"):
            for i in range(n):
                total = total + h[i] * _MULTIPLIERS[i]
        return mix(np.array([total], np.uint64))
    size = n - WIDTH + 1
    total = np.full(size, WIDTH, np.uint64)
    for i in range(WIDTH):
        total += h[i : i + size] * _MULTIPLIERS[i]
    return np.unique(mix(total))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
