"""Vectorised text kernels in numpy, working on UTF-8 bytes of many texts at once.

Words are maximal runs of bytes other than space and U+0009..U+000D, which is
what ``[^\\x20\\x09-\\x0D]+`` matches, as no byte of a longer UTF-8 sequence is
among these.  A word's hash is a polynomial over 64-bit codes of its bytes
modulo 2**64, mixed afterwards; equal words have equal hashes wherever they lie.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(0x5EED)
CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
CODES_LOWER = CODES.copy()
CODES_LOWER[65:91] = CODES[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_CHUNK = 1 << 20
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS))
        for name, base in (("_POWERS", BASE), ("_INVERSES", BASE_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            globals()[name] = np.multiply.accumulate(table)
    return _POWERS[:n], _INVERSES[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over the word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def symbols(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A 64-bit code for each symbol: a byte's from ``codes``, a word's hash as it is."""
    return codes[data] if data.dtype == np.uint8 else data


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = CODES) -> np.ndarray:
    """64-bit hashes of ``data[starts[i]:ends[i]]``, starts and ends ascending.

    Works through the symbols in bounded chunks, however long the texts are.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + _CHUNK, side="right")))
        high = ends[to - 1]
        powers, inverses = _tables(int(high - low) + 1)
        prefix = np.zeros(high - low + 1, np.uint64)
        np.cumsum(symbols(data[low:high], codes) * powers[:-1], out=prefix[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (prefix[e] - prefix[s]) * inverses[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each text's first word (``n + 1`` bounds)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    first[cuts] = solid[cuts]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = cuts[cuts > 0] - 1
    last[inner] = solid[inner]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all ``n`` successive items; those that cross a text's end are
    left for the caller to mask.  Entry ``i`` covers items ``i .. i + n - 1``."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = out * BASE + hashes[k : len(hashes) - n + 1 + k]
    return mix(out)


def gram_mask(bounds: np.ndarray, total: int, n: int) -> np.ndarray:
    """Which of the ``total - n + 1`` gram starts lie wholly inside one text."""
    if total < n:
        return np.zeros(0, bool)
    ok = np.ones(total - n + 1, bool)
    for k in range(1, n):
        bad = bounds[1:] - k
        bad = bad[(bad >= 0) & (bad < len(ok))]
        ok[bad] = False
    # starts of texts shorter than n words are masked by their own ends above
    return ok


def owners(bounds: np.ndarray, total: int) -> np.ndarray:
    """For each item the number of its text."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) if total else np.zeros(0, np.int64)


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Items inside any of the spans ``start .. start + length - 1``."""
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step[:-1]) > 0


def code_points(data: np.ndarray) -> np.ndarray:
    """True at each byte that begins a code point."""
    return (data & 0xC0) != 0x80


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each ``bounds[i]:bounds[i + 1]``, empty ones 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
