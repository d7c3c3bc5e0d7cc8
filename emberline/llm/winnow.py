"""Winnowing anchors: which stretches of texts can hold a repeated string at all.

Of any ``window`` successive starts the one with the least ``gram``-symbol hash, by its
upper bits, is chosen, the last one on a tie.  Equal strings of ``gram + window - 1`` symbols
choose the same start, so a string whose chosen gram is found nowhere else is
found nowhere else itself.  Symbols are bytes, or words given by their hashes.

Strings that lie about alike around their anchor share a longer core than the
gram.  :func:`cores` cuts a run's starts by the distance to the anchor, so that
only strings with equal cores need to be compared.
"""

from __future__ import annotations

import numpy as np

from . import textkernel as K


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all ``gram``-symbol strings of ``data``: bytes, or words' hashes.
    Only their upper bits are well spread."""
    n = len(data)
    if n < gram:
        return np.zeros(0, np.uint64)
    out = np.empty(n - gram + 1, np.uint64)
    step = 1 << 16
    for at in range(0, len(out), step):
        part = data[at : at + step + gram - 1]
        powers, inverses = K._tables(len(part) + 1)
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(K.symbols(part, K.CODES) * powers[:-1], out=prefix[1:])
        m = len(part) - gram + 1
        own = out[at : at + m]
        np.subtract(prefix[gram:], prefix[:m], out=own)
        own *= inverses[:m]
    return out


#: Bits of a position below those of a hash in one key.
_PLACE = 32


def last_least(values: np.ndarray, window: int) -> np.ndarray:
    """For each run of ``window`` successive values the index of the least by its upper 32 bits, the
    last one on a tie.

    Keys hold these bits and the position from the end.  Minima of doubling widths, each from two of the half width.
    """
    n = len(values) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = (1 << _PLACE) - 1
    if len(values) > low:
        raise ValueError("too many values")
    out = np.empty(n, np.int64)
    step = 1 << 16
    for at in range(0, n, step):
        part = values[at : at + step + window - 1]
        least = part & np.uint64(low << _PLACE)
        least |= np.arange(low - at, low - at - len(part), -1).astype(np.uint64)
        width = 1
        while 2 * width <= window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < window:
            least = np.minimum(least[: len(part) - window + 1], least[window - width :])
        least &= np.uint64(low)
        np.subtract(low, least.view(np.int64), out=out[at : at + len(least)])
    return out


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All starts of ``length``-byte strings, gathered by the anchor that they choose:
    text number, first and last start, anchor (all within the text), anchor's hash."""
    hashes = gram_hashes(data, gram)
    anchor = last_least(hashes, length - gram + 1)
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    new[offsets[:-1][offsets[:-1] < len(anchor)]] = True
    first = np.flatnonzero(new)
    text = np.searchsorted(offsets, first, side="right") - 1
    # a start near its text's end would reach into the next text
    last = np.minimum(np.append(first[1:], len(anchor))[: len(first)] - 1, offsets[text + 1] - length)
    first, last, text = (x[first <= last] for x in (first, last, text))
    at, base = anchor[first], offsets[text]
    return text, first - base, last - base, at - base, K.mix(hashes[at])


def reach(length: int, gram: int, parts: int) -> int:
    """Starts of a part, at most; all their strings hold the same ``length - reach`` symbols."""
    return -(-(length - gram + 1) // parts)


def cores(low: np.ndarray, high: np.ndarray, anchor: np.ndarray, length: int, gram: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs cut into at most ``parts`` by the starts' distance to the anchor: the run
    and the part's number, first and last start, first and last symbol of the core.

    All strings of a part hold its core, at the same place from the anchor, so
    equal strings lie in parts of one number with equal cores.
    """
    step = reach(length, gram, parts)
    far, near = (anchor - low) // step, (anchor - high) // step
    count = far - near + 1
    run = np.repeat(np.arange(len(low)), count)
    part = far[run] - (np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count))
    begin = anchor[run] - part * step
    first = np.maximum(low[run], begin - step + 1)
    last = np.minimum(high[run], begin)
    return run, part, first, last, begin, begin - step + length
