"""Multiple-instance objectives with analytic gradients, a quasi-Newton solver,
hard-negative supervision, small trees and policy selection."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expit(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 200, memory: int = 10, tolerance: float = 1e-7) -> np.ndarray:
    """Limited-memory quasi-Newton descent with a backtracking step."""
    value, slope = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(slope).max() < tolerance:
            break
        q, scales = slope.copy(), []
        for s, y in reversed(steps):
            a = s @ q / (s @ y)
            scales.append(a)
            q -= a * y
        if steps:
            s, y = steps[-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(steps, reversed(scales), strict=True):
            q += (a - y @ q / (s @ y)) * s
        move, size = -q, 1.0
        down = slope @ move
        if down >= 0:
            move, down, steps = -slope, -(slope @ slope), []
        while size > 1e-12:
            then, after = f(x + size * move)
            if then <= value + 1e-4 * size * down:
                break
            size /= 2
        else:
            break
        s, y = size * move, after - slope
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        x, value, slope = x + s, then, after
    return x


Loss = Callable[[np.ndarray], tuple[float, np.ndarray]]


def halves(positive: np.ndarray) -> np.ndarray:
    """Weights that give each of two classes half of the mass, evenly within it."""
    members = np.bincount(positive.astype(int), minlength=2)
    return 0.5 / np.maximum(1, members)[positive.astype(int)]


def bag_entropy(positive: np.ndarray, weight: np.ndarray) -> Loss:
    """Weighted cross entropy of bags' probabilities."""

    def loss(q: np.ndarray) -> tuple[float, np.ndarray]:
        q = np.clip(q, 1e-12, 1 - 1e-12)
        right = np.where(positive > 0, q, 1 - q)
        return -float(weight @ np.log(right)), np.where(positive > 0, -weight, weight) / right

    return loss


def pair_spread(pair: np.ndarray, weight: np.ndarray, strength: float) -> Loss:
    """Weighted squares of the bags' distances from the weighted mean of their pair."""
    mass = np.maximum(np.bincount(pair, weight), 1e-20)

    def loss(q: np.ndarray) -> tuple[float, np.ndarray]:
        off = q - (np.bincount(pair, weight * q) / mass)[pair]
        return strength * float(weight @ (off * off)), 2 * strength * weight * off

    return loss


def window_entropy(wanted: np.ndarray, weight: np.ndarray) -> Loss:
    """Weighted cross entropy of windows, from their logits; weightless ones may want anything."""

    def loss(z: np.ndarray) -> tuple[float, np.ndarray]:
        return float(weight @ (np.logaddexp(0, z) - wanted * z)), weight * (0.5 * (1 + np.tanh(z / 2)) - wanted)

    return loss


def pooled(bag: np.ndarray, bags: int, power: float, *losses: Loss) -> Loss:
    """Losses of bags as a loss of windows' logits: a bag's probability is the sum of its
    windows' probabilities to ``power`` over that to ``power - 1``."""

    def loss(z: np.ndarray) -> tuple[float, np.ndarray]:
        p = np.maximum(0.5 * (1 + np.tanh(z / 2)), 1e-15)
        lower = p ** (power - 1)
        below = np.maximum(np.bincount(bag, lower, bags), 1e-300)
        q = np.bincount(bag, p * lower, bags) / below
        parts = [each(q) for each in losses]
        pull = (sum(slope for _, slope in parts) / below)[bag]
        # of p**power and p**(power - 1), each times p (1 - p)
        return sum(value for value, _ in parts), pull * lower * (1 - p) * (power * p - (power - 1) * q[bag])

    return loss


def linear(x: np.ndarray, *losses: Loss) -> Loss:
    """Losses of logits as a loss of the weights and, last, the intercept that give them."""
    wide = np.column_stack([x, np.ones(len(x))])

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        parts = [each(wide @ theta) for each in losses]
        return sum(value for value, _ in parts), wide.T @ sum(slope for _, slope in parts)

    return loss


def together(*losses: Loss) -> Loss:
    return lambda theta: tuple(map(sum, zip(*(each(theta) for each in losses), strict=True)))


def ridge(strength: float) -> Loss:
    """A penalty on all weights, the intercept too."""
    return lambda theta: (0.5 * strength * float(theta @ theta), strength * theta)


def bag_loss(
    x: np.ndarray, bag: np.ndarray, positive: np.ndarray, wanted: np.ndarray, stiffness: float | None = None, power: float = 2.0, share: float = 0.25, mass: np.ndarray | None = None, trust: np.ndarray | None = None,
    pair: np.ndarray | None = None, agree: float = 0.0, extra: tuple[np.ndarray, np.ndarray, np.ndarray, float] | None = None,
) -> Loss:
    """The loss of a linear model over windows in bags.

    Cross entropy of the pooled bags, and ``share`` of that of windows whose state is
    ``wanted`` (-1: unknown), each class of either with half the mass unless bags have
    ``mass`` and windows ``trust``; a penalty, 20 over the bags unless ``stiffness``
    says; ``agree`` times the spread within each ``pair`` of bags; and windows of
    their own ``extra``: ``(x, wanted, weights, strength)``, weights brought to that strength.
    A power of 2 pools by linear softmax.
    """
    mass = halves(positive > 0) if mass is None else mass
    known = wanted >= 0
    held = np.zeros(len(wanted))
    if known.any():
        held[known] = halves(wanted[known] > 0) if trust is None else trust[known] / trust[known].sum()
    of_bags = [bag_entropy(positive, mass)] + ([pair_spread(pair, mass, agree)] if agree else [])
    terms = [linear(x, pooled(bag, len(positive), power, *of_bags), window_entropy(np.maximum(wanted, 0), share * held)), ridge(20.0 / len(positive) if stiffness is None else stiffness)]
    if extra is not None:
        own, state, weight, strength = extra
        terms.append(linear(own, window_entropy(state, strength * weight / weight.sum())))
    return together(*terms)


def fit_bags(pdf: pd.DataFrame, features: list[str], clip: str = "clip", label: str = "positive", target: str = "target", penalty: float | None = None, power: float = 2.0) -> np.ndarray:
    """Weights and intercept for windows of labelled bags."""
    bag, names = pd.factorize(pdf[clip], sort=True)
    positive = pdf.groupby(bag)[label].first().to_numpy(float)
    loss = bag_loss(pdf[features].to_numpy(float), bag, positive, pdf[target].to_numpy(float), penalty, power)
    return minimise(loss, np.zeros(len(features) + 1))


def fit_by_fold(df: DataFrame, fold: str, features: list[str], **how) -> DataFrame:
    """One fit per training fold, each a task: ``fold, name, weight``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        theta = fit_bags(pdf.sort_values(["clip", "frame"]), features, **how)
        return pd.DataFrame({fold: pdf[fold].iloc[0], "name": [*features, "intercept"], "weight": theta})

    return df.groupBy(fold).applyInPandas(run, f"{fold} {df.schema[fold].dataType.simpleString()}, name string, weight double")


def instance_supervision(df: DataFrame, mass: float = 0.75, k: int = 3, known_negative: float = 0.1, clip: str = "clip", p: str = "p", target: str = "target", positive: str = "positive", order: str = "frame", bag_weight: str | None = None) -> DataFrame:
    """Targets and weights of single windows from bags, each of its weight or one.

    A negative bag spreads ``1 - mass`` evenly and ``mass`` on its ``k`` highest
    windows.  A positive bag's weight goes to its known positive windows and its
    highest window not known negative; its known negatives share a part of it.  A
    positive bag of known negatives only fails the job.
    """
    own = Window.partitionBy(clip)
    rank = F.row_number().over(own.orderBy(F.col(p).desc(), order))
    best = F.row_number().over(own.orderBy((F.col(target) == 0).cast("int"), F.col(p).desc(), order)) == 1
    out = df.withColumn("_n", F.count(F.lit(1)).over(own)).withColumn("_rank", rank).withColumn("_best", best)
    y = F.when(~F.col(positive), 0).when((F.col(target) == 1) | (F.col("_best") & (F.col(target) != 0)), 1).when(F.col(target) == 0, 0).otherwise(-1)
    out = out.withColumn("y", y)
    ones = F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).over(own)
    zeros = F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).over(own)
    weight = (
        F.when(~F.col(positive), (1.0 - mass) / F.col("_n") + F.when(F.col("_rank") <= k, mass / F.least(F.col("_n"), F.lit(k))).otherwise(0.0))
        .when(F.col("y") == 1, 1.0 / ones).when(F.col("y") == 0, known_negative / zeros).otherwise(0.0)
    )
    # only where a positive bag's best window is a known negative are all of them
    empty = F.col(positive) & F.col("_best") & (F.col(target) == 0)
    checked = F.when(empty, F.raise_error("a positive bag has known negative windows only").cast("double")).otherwise(weight * (F.lit(1.0) if bag_weight is None else F.col(bag_weight)))
    return out.withColumn("weight", checked).drop("_n", "_rank", "_best")


def reweight_hard(weight: Column, p: Column, positive: Column, by: Window) -> Column:
    """Negatives' weights times ``1 + 7 p**2``, then back to their class's mass."""
    raised = F.when(positive, weight).otherwise(weight * (1.0 + 7.0 * p * p))
    return raised * F.sum(weight).over(by) / F.sum(raised).over(by)


def select_policy(scores: DataFrame, baseline: str, grid: list[float], label: str = "positive", score: str = "score") -> DataFrame:
    """The candidate and threshold that keep every positive that the baseline
    catches at 0.8, with at least a fifth fewer false alerts; fewest of these,
    then most caught, declared order, threshold nearest 0.8; else the baseline.

    ``scores(candidate, candidate_order, clip, positive, score)``.
    """
    base = scores.where(F.col("candidate") == baseline).select("clip", (F.col(score) >= 0.8).alias("_base"))
    base_fp = base.join(scores.where(F.col("candidate") == baseline).select("clip", label), "clip").agg(F.sum(F.when(~F.col(label) & F.col("_base"), 1).otherwise(0)).alias("_fp"))
    tried = scores.join(base, "clip").withColumn("threshold", F.explode(F.array(*map(F.lit, grid))))
    hit = F.col(score) >= F.col("threshold")
    sums = tried.groupBy("candidate", "candidate_order", "threshold").agg(
        F.sum(F.when(F.col(label) & hit, 1).otherwise(0)).alias("tp"), F.sum(F.when(~F.col(label) & hit, 1).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col(label) & F.col("_base") & ~hit, 1).otherwise(0)).alias("lost"),
    )
    fine = sums.crossJoin(F.broadcast(base_fp)).where((F.col("lost") == 0) & (F.col("fp") < F.col("_fp")) & (F.col("fp") <= 0.8 * F.col("_fp")))
    best = fine.orderBy("fp", F.col("tp").desc(), "candidate_order", F.abs(F.col("threshold") - 0.8), "threshold", "candidate").limit(1).select("candidate", "threshold", F.lit(0).alias("_else"))
    fall = scores.sparkSession.range(1).select(F.lit(baseline).alias("candidate"), F.lit(0.8).alias("threshold"), F.lit(1).alias("_else"))
    return best.unionByName(fall).orderBy("_else").limit(1).drop("_else")


def select_robust(scores: DataFrame, primary: str, label: str = "positive") -> DataFrame:
    """The model that keeps the primary's caught positives at both tiers in every
    view, with fewest red, then yellow false alerts, then declared order.

    ``scores(candidate, candidate_order, view, clip, positive, score)``.
    """
    own = scores.where(F.col("candidate") == primary).select("view", "clip", F.col("score").alias("_own"))
    both = scores.join(own, ["view", "clip"])
    lost = F.col(label) & (((F.col("_own") >= 0.8) & (F.col("score") < 0.8)) | ((F.col("_own") >= 0.6) & (F.col("score") < 0.6)))
    sums = both.groupBy("candidate", "candidate_order").agg(
        F.sum(F.when(lost, 1).otherwise(0)).alias("lost"), F.sum(F.when(~F.col(label) & (F.col("score") >= 0.8), 1).otherwise(0)).alias("red"),
        F.sum(F.when(~F.col(label) & (F.col("score") >= 0.6) & (F.col("score") < 0.8), 1).otherwise(0)).alias("yellow"),
    )
    return sums.where("lost = 0").orderBy("red", "yellow", "candidate_order").limit(1)


def export_tree(model) -> list[dict]:
    """A fitted MLlib tree as a node table for :func:`emberline.operators.vectors.tree_value`."""
    rows = {}

    def walk(node, at: int) -> int:
        if node.numDescendants() == 0:
            rows[at] = {"leaf": True, "value": node.prediction(), "feature": None, "threshold": None, "left": None, "right": None}
            return at + 1
        rows[at] = own = {"leaf": False, "value": None, "feature": node.split().featureIndex(), "threshold": node.split().threshold(), "left": at + 1, "right": None}
        after = walk(node.leftChild(), at + 1)
        own["right"] = after
        return walk(node.rightChild(), after)

    walk(model._java_obj.rootNode(), 0)
    return [rows[i] for i in range(len(rows))]


def spline_basis(x: Column, knots: tuple[float, float, float]) -> list[Column]:
    """A quadratic spline's terms over three knots, constant outside them."""
    held = F.greatest(F.lit(knots[0]), F.least(F.lit(knots[2]), x))
    return [held, held * held, F.pow(F.greatest(held - knots[1], F.lit(0.0)), F.lit(2.0))]


def gated(score: Column, clip_score: Column) -> Column:
    return score * F.pow(clip_score, F.lit(0.25))
