"""Persistent segment trees in numpy: a forest of them, one tree a group, one version a moment.

Each update copies the path from the root to one leaf; copies share the
subtrees that the update leaves alone.  All copies of one level are made at
once: sorted by node and time, a node's counts are running sums, and its
children's latest copies are running maxima of the updates that went left or
right; splitting each node's updates in two gives the order of the level below.
"""

from __future__ import annotations

import numpy as np


class PersistentForest:
    """Counts of marks by position, as they were after each moment.

    ``group, moment, position`` are whole numbers below ``groups``, any, and
    ``2 ** bits``; ``change`` is added at the position.  A tree's moments may
    be asked for in any order, also between and after those of updates.
    """

    def __init__(self, groups: int, bits: int, group: np.ndarray, moment: np.ndarray, position: np.ndarray, change: np.ndarray, span: int):
        order = np.argsort(group * span + moment, kind="stable")
        self.bits, self.span = bits, span
        self.moments = (group * span + moment)[order]
        position, change, group = position[order], change[order], group[order]
        n = len(order)
        at, by = np.arange(n), np.arange(n)
        self.counts, self.left, self.right = [], [], []
        for level in range(bits + 1):
            node = ((group << level) | (position >> (bits - level)))[by]
            heads = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if n else at
            lengths = np.diff(np.r_[heads, n])
            first = np.repeat(heads, lengths)
            sums = np.cumsum(change[by])
            count = np.empty(n, np.int32)
            count[by] = sums - np.where(first > 0, sums[first - 1], 0)
            self.counts.append(count)
            if level < bits and n:
                right = ((position[by] >> (bits - level - 1)) & 1) > 0
                for side, pointers in ((~right, self.left), (right, self.right)):
                    last = np.maximum.accumulate(np.where(side, at, -1))
                    copy = np.empty(n, np.int32)
                    copy[by] = np.where(last >= first, by[last], -1)
                    pointers.append(copy)
                # each node's updates, those to the left first, in order of time
                lefts = np.cumsum(~right)
                in_node = lefts - np.where(first > 0, lefts[first - 1], 0)
                all_left = np.repeat(np.add.reduceat(~right, heads, dtype=np.int64), lengths)
                place = np.where(right, all_left + at - in_node, first + in_node - 1)
                after = np.empty_like(by)
                after[place] = by
                by = after

    def suffix(self, group: np.ndarray, moment: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Marks at ``start`` or beyond in each group's tree as it was after ``moment``."""
        total = np.zeros(len(group), np.int64)
        if not len(self.moments):
            return total
        root = np.searchsorted(self.moments, group * self.span + moment, side="right") - 1
        # the root is the group's own only if its latest update is
        copy = np.where((root >= 0) & (self.moments[root] // self.span == group), root, -1)
        for level in range(self.bits):
            live = copy >= 0
            go_right = ((start >> (self.bits - level - 1)) & 1) > 0
            left, right = np.where(live, self.left[level][copy], -1), np.where(live, self.right[level][copy], -1)
            whole = ~go_right & (right >= 0)
            total += np.where(whole, self.counts[level + 1][right], 0)
            copy = np.where(go_right, right, left)
        return total + np.where(copy >= 0, self.counts[self.bits][copy], 0)
