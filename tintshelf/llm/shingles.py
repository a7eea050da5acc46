"""Word shingles of texts as NumPy arrays of 64-bit hashes, for use inside tasks."""

from __future__ import annotations

import re
import sys

import numpy as np

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII other than digits and letters, as UTF-8; A-Z lower-cased; null counts as empty.

    All bytes of characters beyond ASCII are above 0x7F, so the runs of bytes are the runs of characters.
    """
    return _WORD.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER)) if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHash:
    """64-bit hashes of words, the same in every process; remembers a bounded number of words."""

    def __init__(self, most: int = 300_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, found: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(found):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words; none if there are fewer words."""
    if n < 1 or len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    m = len(hashes) - n + 1
    out = np.full(m, n, dtype=np.uint64)
    for k in range(n):
        out = mixed(out * _STEP + hashes[k : k + m])
    return out


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingles; a text of fewer than ``n`` words is one shingle, a text without words has none."""
    return np.unique(grams(hashes, min(n, len(hashes))))


assert sys.byteorder == "little"  # stored sets are little-endian
