"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai's common prefixes, search.

A shard is a set of segments laid end to end; suffixes end with their segment.
Symbols are bytes, or numbers from 0 within the shard.
A suffix's rank is the slot where its class of yet equal suffixes begins, and
each round sorts the classes still open by the rank ``h`` further on, doubling
``h``.  Sort keys hold rank, rank and position in one 64-bit word, so a shard
holds fewer than 2**21 bytes.
"""

from __future__ import annotations

import numpy as np

FIELD = 21
MOST = (1 << FIELD) - 2


def suffix_array(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order; equal ones by position."""
    # as many first symbols as a sort key holds, each above the end's 0
    bits = 9 if data.dtype == np.uint8 else max(9, int(data.max(initial=0) + 1).bit_length())
    first = max(1, (64 - FIELD) // bits)
    n = len(data)
    if n > MOST:
        raise ValueError("too long for one shard")
    if n == 0:
        return np.zeros(0, np.int64)
    end = np.repeat(bounds[1:], np.diff(bounds))
    place = np.arange(n, dtype=np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(first):
        at = np.minimum(np.arange(n) + k, n - 1)
        symbol = np.where(np.arange(n) + k < end, data[at].astype(np.uint64) + np.uint64(1), np.uint64(0))
        key = (key << np.uint64(bits)) | symbol
    key = np.sort((key << np.uint64(FIELD)) | place)
    mask = np.uint64((1 << FIELD) - 1)
    order = (key & mask).astype(np.int64)
    head = key >> np.uint64(FIELD)
    rank = np.empty(n, np.int64)

    def settle(slots: np.ndarray, members: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Ranks of ``members`` in ``slots``; which of them stay open."""
        new = np.ones(len(slots), bool)
        new[1:] = classes[1:] != classes[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(slots)))
        rank[members] = np.repeat(slots[first], size)
        return np.repeat(size > 1, size)

    slots = np.arange(n)
    open_ = settle(slots, order, head)
    h = first
    while True:
        slots = slots[open_]
        if not len(slots):
            return order
        members = order[slots]
        on = members + h
        inside = on < end[members]
        after = np.where(inside, rank[np.minimum(on, n - 1)] + 1, 0)
        key = np.sort((rank[members].astype(np.uint64) << np.uint64(2 * FIELD)) | (after.astype(np.uint64) << np.uint64(FIELD)) | members.astype(np.uint64))
        members = (key & mask).astype(np.int64)
        order[slots] = members
        classes = key >> np.uint64(FIELD)
        # suffixes that have ended and are equal stay in order of position
        open_ = settle(slots, members, classes) & ((classes & mask) > 0)
        h *= 2


def common_prefixes(data: np.ndarray, bounds: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each position the common prefix with the suffix before it in order, up to ``most``.

    A suffix shares at least one byte less than the suffix one position before
    it did, so each segment is passed once; all segments step together.
    """
    n = len(data)
    out = np.zeros(n, np.int64)
    if n == 0:
        return out
    end = np.repeat(bounds[1:], np.diff(bounds))
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    size = np.diff(bounds)
    by_size = np.argsort(-size, kind="stable")
    begin, size = bounds[:-1][by_size], size[by_size]
    shared = np.zeros(len(size), np.int64)
    for step in range(int(size[0])):
        live = int(np.searchsorted(-size, -step, side="left"))
        at = begin[:live] + step
        pred = before[at]
        h = np.maximum(shared[:live] - 1, 0)
        h[pred < 0] = 0
        left = np.minimum(np.minimum(end[at] - at, np.where(pred < 0, 0, end[pred] - pred)), most)
        h = np.minimum(h, left)
        go = np.flatnonzero(h < left)
        while len(go):
            same = data[at[go] + h[go]] == data[pred[go] + h[go]]
            go = go[same]
            h[go] += 1
            go = go[h[go] < left[go]]
        out[at] = h
        shared[:live] = h
    return out


def alike(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of ``length``-symbol strings in order, and numbers from 0 that equal strings share."""
    order = suffix_array(data, bounds)
    shared = common_prefixes(data, bounds, order, length)
    end = np.repeat(bounds[1:], np.diff(bounds))
    # a suffix too short for a string lies between no two equal strings
    starts = order[order + length <= end[order]]
    new = shared[starts] < length
    new[:1] = False
    return starts, np.cumsum(new)


def _words(data: np.ndarray, length: int) -> np.ndarray:
    """Big-endian 8-byte words at each position, zeros past the end; of other
    symbols each by itself."""
    if data.dtype != np.uint8:
        return np.concatenate([data, np.zeros(length, data.dtype)])
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data) + length, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(out)]
    return out


def search(data: np.ndarray, starts: np.ndarray, other: np.ndarray, queries: np.ndarray, length: int) -> np.ndarray:
    """For each ``length``-symbol string ``other[q:q + length]`` the first index into
    ``starts`` (ordered by the strings there) of an equal one, or -1, by binary search."""
    a, b = _words(data, length), _words(other, length)
    step = 8 if data.dtype == np.uint8 else 1
    whole, rest = divmod(length, step)
    tail = np.uint64((0xFFFFFFFFFFFFFFFF << (64 - 8 * rest)) & 0xFFFFFFFFFFFFFFFF) if rest else np.uint64(0)

    def compare(at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Sign of the string at ``at`` against the query."""
        out = np.zeros(len(at), np.int8)
        todo = np.arange(len(at))
        for k in range(whole + bool(rest)):
            x, y = a[at[todo] + step * k], b[q[todo] + step * k]
            if k == whole:
                x, y = x & tail, y & tail
            out[todo] = (x > y).astype(np.int8) - (x < y).astype(np.int8)
            todo = todo[x == y]
            if not len(todo):
                break
        return out

    low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(starts), np.int64)
    while True:
        going = np.flatnonzero(low < high)
        if not len(going):
            break
        mid = (low[going] + high[going]) // 2
        less = compare(starts[mid], queries[going]) < 0
        low[going[less]] = mid[less] + 1
        high[going[~less]] = mid[~less]
    found = np.full(len(queries), -1, np.int64)
    some = np.flatnonzero(low < len(starts))
    equal = some[compare(starts[low[some]], queries[some]) == 0] if len(some) else some
    found[equal] = low[equal]
    return found
