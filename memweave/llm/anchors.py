"""Content-chosen anchors of fixed-length windows (NumPy, inside tasks).

Every ``window``-byte string of a text is given to one of its ``gram``-byte strings: the
one with the smallest hash, the last of equals. The choice depends on the string alone,
so equal strings choose alike wherever they are. An anchor is a gram with the run of
neighbouring windows that chose it; its context is all bytes of those windows.
"""

from __future__ import annotations

import numpy as np
import xxhash

WINDOW, GRAM = 100, 32
_RNG = np.random.default_rng(20260102)
_BYTE = _RNG.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_BASE = (np.uint64(0xD1342543DE82EF95), np.uint64(0x2545F4914F6CDD1D))
_INVERSE = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASE)
#: Bytes of text hashed at once, so many that the arrays stay in the processor's cache; longer texts go in overlapping blocks.
BLOCK = 1 << 18
#: Low bits of an ordering key, which hold the place.
_PLACE = np.uint64((1 << 21) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[int, tuple] = {}


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 15)
        grow = lambda b: np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]))
        _POWERS[which] = have = (grow(_BASE[which]), grow(_INVERSE[which]))
    return have[0][:n], have[1][:n]


def prefix_sums(raw: np.ndarray, which: int) -> np.ndarray:
    up, _ = _powers(len(raw), which)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[which][raw] * up, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """64-bit hashes of the byte strings [start, end), equal for equal strings."""
    _, down = _powers(len(sums), which)
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def named(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit names of the byte strings [start, end) by a hash of all their bytes."""
    view, name = memoryview(np.ascontiguousarray(raw)), xxhash.xxh3_64_intdigest
    return np.fromiter((name(view[a:z]) for a, z in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def _block(raw: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes; for each run of windows with one anchor, its first window and the anchor's place."""
    n = len(raw)
    sums = prefix_sums(raw, 0)
    _, down = _powers(n + 1, 0)
    grams = _mix((sums[gram:] - sums[: n - gram + 1]) * down[: n - gram + 1])
    # ordered by the hash's high bits, then from right to left: still a choice by the string alone
    order = (grams & ~_PLACE) | (_PLACE - np.arange(len(grams), dtype=np.uint64))
    width = window - gram + 1
    count = len(grams) - width + 1
    tiles = np.full(-(-len(grams) // width) * width, ~np.uint64(0))
    tiles[: len(grams)] = order
    tiles = tiles.reshape(-1, width)
    ahead = np.minimum.accumulate(tiles, 1).ravel()
    back = np.minimum.accumulate(tiles[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(back[:count], ahead[width - 1 : width - 1 + count])
    starts = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1])
    return grams, starts, (_PLACE - (least[starts] & _PLACE)).astype(np.int64)


def _valid(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts laid end to end: each window's text, and whether the window ends in it."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    n = len(text) - window + 1
    return text[:n], text[:n] == text[window - 1 :]


def anchors_of(texts: list[np.ndarray], window: int = WINDOW, gram: int = GRAM, context: bool = True) -> tuple[np.ndarray, ...]:
    """Text number, first window, number of windows, gram hash and context hash of every anchor."""
    empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    out, k = [], 0
    while k < len(texts):
        if len(texts[k]) > BLOCK:
            out += _long(texts[k], k, window, gram, context)
            k += 1
            continue
        end, size = k, 0
        while end < len(texts) and len(texts[end]) <= BLOCK and size <= BLOCK:
            size += len(texts[end])
            end += 1
        sizes = np.array([len(t) for t in texts[k:end]])
        raw = np.concatenate(texts[k:end])
        if len(raw) >= window:
            grams, starts, place = _block(raw, window, gram)
            text, good = _valid(sizes, window)
            # runs end where their text does
            breaks = np.zeros(len(text), bool)
            breaks[starts] = True
            breaks[1:] |= (text[1:] != text[:-1]) | (good[1:] != good[:-1])
            first = np.flatnonzero(breaks)
            place = np.repeat(place, np.diff(np.append(starts, len(text))))[first]
            count = np.diff(np.append(first, len(text)))
            keep = good[first]
            first, count, place = first[keep], count[keep], place[keep]
            own = text[first]
            hashes = named(raw, first, first + count + window - 1) if context else np.zeros(len(first), np.uint64)
            out.append((own + k, first - (np.cumsum(sizes) - sizes)[own], count, grams[place], hashes))
        k = end
    return tuple(np.concatenate(x) for x in zip(*(out or [empty]), strict=True))


def _long(raw: np.ndarray, number: int, window: int, gram: int, context: bool) -> list[tuple[np.ndarray, ...]]:
    out = []
    for at in range(0, len(raw) - window + 1, BLOCK):
        part = raw[at : at + BLOCK + window - 1]
        grams, starts, place = _block(part, window, gram)
        count = np.diff(np.append(starts, len(part) - window + 1))
        names = named(part, starts, starts + count + window - 1) if context else np.zeros(len(starts), np.uint64)
        out.append((np.full(len(starts), number), starts + at, count, grams[place], names))
    return out


def places(raw: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The place of every window's anchor."""
    out = []
    for at in range(0, len(raw) - window + 1, BLOCK):
        part = raw[at : at + BLOCK + window - 1]
        _, starts, place = _block(part, window, gram)
        out.append(np.repeat(place, np.diff(np.append(starts, len(part) - window + 1))) + at)
    return np.concatenate(out)
