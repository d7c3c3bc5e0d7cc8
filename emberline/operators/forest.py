"""Extremely randomised trees: random cut points, all trees grown together, one aggregation a level.

Each node draws some features and, for each, one cut between the least and the
greatest value that its rows have.  Which features the two children will draw
is known before the node's cut is chosen, so one pass over the rows gives the
sums on both sides of every cut and, for each side, the ranges that the child
needs for its own cuts.  Only the chosen cuts come to the driver: one row a
node, so trees times two to the depth bounds what is held.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MASK = (1 << 64) - 1


def uniform(*counters: np.ndarray | int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the counters alone."""
    shape = np.broadcast_shapes(*(np.shape(c) for c in counters))
    h = np.full(shape, 0x243F6A8885A308D3, np.uint64)
    with np.errstate(over="ignore"):
        for c in counters:
            h = (h ^ np.asarray(c).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
            for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
            h ^= h >> np.uint64(31)
    return (h >> np.uint64(11)).astype(float) / (1 << 53)


def drawn(seed: int, tree: int, node: np.ndarray, features: int, most: int) -> np.ndarray:
    """The features that each node draws, without repetition."""
    return np.argsort(uniform(seed, 1, tree, node[:, None], np.arange(features)), axis=1, kind="stable")[:, :most]


def cut_points(seed: int, tree: int, node: np.ndarray, feature: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A cut between the bounds of each; NaN where all values are equal or there are none."""
    return np.where(hi > lo, lo + uniform(seed, 2, tree, node[:, None], feature) * (hi - lo), np.nan)


@dataclass
class Forest:
    """``splits[tree][node] = (feature, cut)``, ``leaves[tree][node]`` the share of positives; nodes are numbered from 1, children 2n and 2n + 1."""

    features: list[str]
    splits: list[dict[int, tuple[int, float]]] = field(default_factory=list)
    leaves: list[dict[int, float]] = field(default_factory=list)
    gains: np.ndarray | None = None

    def importances(self) -> dict[str, float]:
        """Each feature's share of the impurity that a tree removes, averaged over trees that split at all."""
        sums = self.gains.sum(axis=1, keepdims=True)
        some = sums[:, 0] > 0
        share = (self.gains[some] / sums[some]).mean(axis=0) if some.any() else np.zeros(len(self.features))
        return dict(zip(self.features, share.tolist(), strict=True))

    def nodes(self, tree: int, x: np.ndarray, levels: int) -> np.ndarray:
        """Where each row is after ``levels`` steps, or the leaf where it stopped before; missing values go left."""
        at = np.ones(len(x), np.int64)
        for depth in range(levels):
            known = [(n, *s) for n, s in self.splits[tree].items() if 1 << depth <= n < 2 << depth]
            if not known:
                break
            number, feature, cut = (np.array(v) for v in zip(*sorted(known), strict=True))
            spot = np.minimum(np.searchsorted(number, at), len(number) - 1)
            on = number[spot] == at
            right = x[np.arange(len(x)), feature[spot]] > cut[spot]
            at = np.where(on, 2 * at + right, at)
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree, leaf in enumerate(self.leaves):
            deepest = max(leaf).bit_length()
            number, value = (np.array(v) for v in zip(*sorted(leaf.items()), strict=True))
            total += value[np.searchsorted(number, self.nodes(tree, x, deepest))]
        return total / len(self.leaves)


def matrix(batch: pa.RecordBatch, first: int, features: int) -> np.ndarray:
    """Columns from ``first`` on as floats, null as NaN."""
    return np.column_stack([batch.column(first + k).to_numpy(zero_copy_only=False).astype(float) for k in range(features)]) if features else np.zeros((batch.num_rows, 0))


def extra_trees(df: DataFrame, features: list[str], positive: str, weight: str | None = None, trees: int = 20, depth: int = 8, most: int | None = None, least: int = 1, seed: int = 0) -> Forest:
    """Trees over all rows, each grown to ``depth`` at most, from splits that leave ``least`` rows on either side.

    A node draws ``most`` features (the square root of all unless given), takes
    the cut with the greatest fall of the weighted Gini impurity, the first
    drawn among equals, and is a leaf if it is pure or no cut divides it.
    Rows without ``positive`` take no part; missing values go left and set no bounds.
    """
    k = max(1, round(len(features) ** 0.5)) if most is None else min(most, len(features))
    rows = df.where(F.col(positive).isNotNull()).select(F.col(positive).cast("double").alias("y"), (F.lit(1.0) if weight is None else F.col(weight)).cast("double").alias("w"), *(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)))
    value = lambda i: F.when(~F.isnan(f"x{i}"), F.col(f"x{i}"))
    sums = rows.agg(F.count("y").alias("c"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("p"), *(f(value(i)).alias(f"{n}{i}") for i in range(len(features)) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    model = Forest(features, [{} for _ in range(trees)], [{} for _ in range(trees)], np.zeros((trees, len(features))))
    if not sums.c:
        raise ValueError("no rows to learn from")
    lo, hi = (np.array([np.nan if sums[f"{n}{i}"] is None else sums[f"{n}{i}"] for i in range(len(features))]) for n in ("lo", "hi"))
    # open nodes by tree: numbers, drawn features, cuts, and whether they can be divided at all
    open_: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for t in range(trees):
        model.leaves[t][1] = sums.p / sums.w
        pick = drawn(seed, t, np.array([1]), len(features), k)
        if 0 < sums.p < sums.w and depth:
            open_[t] = np.array([1]), pick, cut_points(seed, t, np.array([1]), pick, lo[pick], hi[pick])
    for level in range(depth):
        if not open_:
            break
        found = _grown(rows, model, open_, level, k, len(features), least, seed)
        grown: dict[int, list] = {}
        for r in found:
            t, n = r.tree, r.node
            j = int(np.flatnonzero(open_[t][0] == n)[0])
            model.splits[t][n] = int(open_[t][1][j, r.k]), float(open_[t][2][j, r.k])
            model.gains[t, model.splits[t][n][0]] += r.gain
            del model.leaves[t][n]
            for side, (p, w, lows, highs) in enumerate(((r.p0, r.w0, r.lo0, r.hi0), (r.p1, r.w1, r.lo1, r.hi1))):
                model.leaves[t][2 * n + side] = p / w
                if 0 < p < w and level + 1 < depth:
                    grown.setdefault(t, []).append((2 * n + side, np.array(lows, float), np.array(highs, float)))
        open_ = {}
        for t, nodes in grown.items():
            number = np.array([n for n, *_ in nodes])
            pick = drawn(seed, t, number, len(features), k)
            open_[t] = number, pick, cut_points(seed, t, number, pick, np.stack([x for _, x, _ in nodes]), np.stack([x for *_, x in nodes]))
    return model


def _grown(rows: DataFrame, model: Forest, open_: dict, level: int, k: int, width: int, least: int, seed: int) -> list:
    """The best cut of each open node that has one, with both sides' sums and the ranges of what each child draws."""
    state = {t: (np.argsort(n), n, pick, cut, [drawn(seed, t, 2 * n + side, width, k) for side in (0, 1)]) for t, (n, pick, cut) in open_.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            y, w, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch, 2, width)
            for t, (order, number, pick, cut, child) in state.items():
                at = model.nodes(t, x, level)
                spot = order[np.minimum(np.searchsorted(number[order], at), len(number) - 1)]
                on = np.flatnonzero(number[spot] == at)
                if not len(on):
                    continue
                own, spot = x[on], spot[on]
                side = (own[np.arange(len(on))[:, None], pick[spot]] > cut[spot]).astype(int)
                cell = ((spot[:, None] * k + np.arange(k)) * 2 + side).ravel()
                cells = len(number) * k * 2
                if t not in held:
                    held[t] = [np.zeros(cells), np.zeros(cells), np.zeros(cells), np.full((cells, k), np.inf), np.full((cells, k), -np.inf)]
                count, weight, positive, low, high = held[t]
                count += np.bincount(cell, minlength=cells)
                weight += np.bincount(cell, np.repeat(w[on], k), cells)
                positive += np.bincount(cell, np.repeat((w * y)[on], k), cells)
                for j in range(k):
                    feature = np.where(side == 1, child[1][spot, j][:, None], child[0][spot, j][:, None])
                    v = own[np.arange(len(on))[:, None], feature].ravel()
                    good = ~np.isnan(v)
                    np.minimum.at(low[:, j], cell[good], v[good])
                    np.maximum.at(high[:, j], cell[good], v[good])
        for t, (count, weight, positive, low, high) in held.items():
            some = np.flatnonzero(count)
            number = state[t][1][some // (2 * k)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), t, np.int32)), pa.array(number), pa.array((some // 2 % k).astype(np.int32)), pa.array((some % 2).astype(np.int32)), pa.array(count[some].astype(np.int64)), pa.array(weight[some]), pa.array(positive[some]),
                 *(pa.array(v[some, j]) for v in (low, high) for j in range(k))],
                ["tree", "node", "k", "side", "c", "w", "p", *(f"{n}{j}" for n in ("lo", "hi") for j in range(k))],
            )

    ranges = ", ".join(f"{n}{j} double" for n in ("lo", "hi") for j in range(k))
    parts = rows.mapInArrow(run, f"tree int, node long, k int, side int, c long, w double, p double, {ranges}")
    sides = parts.groupBy("tree", "node", "k", "side").agg(*(F.sum(c).alias(c) for c in "cwp"), *((F.min if n == "lo" else F.max)(f"{n}{j}").alias(f"{n}{j}") for n in ("lo", "hi") for j in range(k)))
    packed = F.struct("c", "w", "p", *(F.array(*(f"{n}{j}" for j in range(k))).alias(n) for n in ("lo", "hi")))
    both = sides.groupBy("tree", "node", "k").agg(*(F.max(F.when(F.col("side") == s, packed)).alias(f"s{s}") for s in (0, 1))).where(F.col("s0").isNotNull() & F.col("s1").isNotNull() & (F.least("s0.c", "s1.c") >= least))
    gini = lambda p, w: 2 * p * (1 - p / w)
    p0, p1, w0, w1 = (F.col(c) for c in ("s0.p", "s1.p", "s0.w", "s1.w"))
    gain = gini(p0 + p1, w0 + w1) - gini(p0, w0) - gini(p1, w1)
    best = both.where((w0 > 0) & (w1 > 0)).withColumn("gain", gain).groupBy("tree", "node").agg(F.max_by(F.struct("k", "gain", "s0", "s1"), F.struct("gain", -F.col("k"))).alias("b"))
    return best.select("tree", "node", "b.k", "b.gain", *(F.col(f"b.s{s}.{n}").alias(f"{n}{s}") for s in (0, 1) for n in ("w", "p", "lo", "hi"))).collect()


def forest_scores(df: DataFrame, model: Forest, keep: list[str], name: str = "score") -> DataFrame:
    """``keep`` columns with the mean share of positives in the leaves that a row reaches."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(matrix(batch, len(keep), len(model.features)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keep))), pa.array(score)], [*keep, name])

    rows = df.select(*keep, *(F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(model.features)))
    return rows.mapInArrow(run, f"{kinds}, `{name}` double")
