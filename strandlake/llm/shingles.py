"""Sets of word shingles as sorted 64-bit hashes, and their signatures."""

from __future__ import annotations

import numpy as np
import xxhash

from strandlake.llm import common

WORDS = 5
REMEMBER, LONGEST = 400_000, 64
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class _Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= LONGEST:
            self[word] = h
        return h


_WORDS = _Words()
common.CACHES["shingles"] = _WORDS.clear


def _final(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct shingles of a text (A-Z in lower case, words parted by ASCII white space), sorted; a text of fewer words has one."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if len(_WORDS) > REMEMBER:
        _WORDS.clear()
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    if n < WORDS:
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=n)], np.uint64)
    out = h[: n - WORDS + 1] * _MIX[0]
    for k in range(1, WORDS):
        out ^= (out >> np.uint64(29)) + h[k : n - WORDS + 1 + k] * _MIX[k]
        out *= _MIX[(k + 1) % WORDS]
    return np.unique(_final(out))


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), seed=len(s) & 0xFFFFFFFF)).astype(np.int64))


def width(n: int) -> int:
    """Bits of the bitmap of a set of n: about two for each member at least, up to 16384."""
    return 1024 if n <= 512 else 4096 if n <= 2048 else 16384


def bitmap(s: np.ndarray) -> np.ndarray:
    """The set's bitmap as packed words: the bit of a member is its lowest bits, so a wider bitmap folds to a narrower one."""
    w = width(len(s))
    bits = np.zeros(w, bool)
    bits[(s & np.uint64(w - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view("<u8")


def fold(bitmaps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (a row each) at a narrower width."""
    n, w = bitmaps.shape
    return bitmaps if w == words else np.bitwise_or.reduce(bitmaps.reshape(n, w // words, words), axis=1)
