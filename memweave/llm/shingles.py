"""Word shingle sets of whole texts as sorted 64-bit hashes (NumPy, inside tasks).

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text, with
A-Z in lower case. A text with fewer words than a shingle is one shingle; a text
without words, or a null, has none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

_PLACE = np.random.default_rng(20260101).integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # of bytes: A-Z, and the six white-space bytes


def word_hashes(own: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))


def word_shingles(text: str | None, k: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles themselves."""
    own = words(text)
    return set(zip(*(own[j:] for j in range(min(k, len(own))))))


def shingle_set(text: str | list[bytes] | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of a text, or of its words."""
    w = word_hashes(text if isinstance(text, list) else words(text))
    if not len(w):
        return w
    n = min(k, len(w))
    out = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        out += w[j : len(w) - n + 1 + j] * _PLACE[j]
    out = np.sort(mix(out))
    return out[np.diff(out, prepend=out[0] + np.uint64(1)) != 0]


def text_key(own: list[bytes]) -> bytes | None:
    """128 bits of BLAKE2b that name a sequence of words; None without words.

    Texts of one key have one set. Hashes of words only propose: sets that are equal by
    them, under different keys, are linked once their words have been compared.
    """
    return hashlib.blake2b(b" ".join(own), digest_size=16).digest() if own else None


def permutations(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, n, dtype=np.uint64)


def minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest value of each universal hash a*x+b mod 2^64 over the set, high half."""
    out = np.full(len(a), ~np.uint64(0))
    for k in range(0, len(s), 512):
        np.minimum(out, (s[k : k + 512, None] * a + b).min(0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, in whole numbers."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both) and both > 0


def similar_words(x: set, y: set, percent: int) -> bool:
    both = len(x & y)
    return 100 * both >= percent * (len(x) + len(y) - both) and both > 0
