"""A Gaussian kernel by random Fourier features: a fixed random map, and a linear model over it.

``exp(-gamma |x - y|^2)`` is the expected product of ``sqrt(2) cos(w.x + b)`` at
both points, for normal ``w`` of variance ``2 gamma`` and even ``b``.  The mean
over ``size`` draws is off by ``4 / sqrt(size)`` or more for about one pair in
three thousand.  Draws depend on the seed alone, so the map is its parameters;
it and the score are expressions over the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.scalars import logistic

from .forest import uniform


def frequencies(inputs: int, size: int, gamma: float, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``size`` directions of ``inputs`` entries, and their phases."""
    i, j = np.arange(size)[:, None], np.arange(inputs)
    normal = np.sqrt(-2 * np.log(1 - uniform(seed, 3, i, j))) * np.cos(2 * np.pi * uniform(seed, 4, i, j))
    return normal * np.sqrt(2 * gamma), 2 * np.pi * uniform(seed, 5, np.arange(size))


def wave(inputs: list[Column], direction: np.ndarray, phase: float) -> Column:
    turned = F.lit(float(phase))
    for x, w in zip(inputs, direction, strict=True):
        turned = turned + x * float(w)
    return F.cos(turned)


def fourier(inputs: list[Column], directions: np.ndarray, phases: np.ndarray) -> Column:
    """The features of a row as an array; products of two rows' approximate their kernel."""
    scale = float(np.sqrt(2 / len(phases)))
    return F.array(*(scale * wave(inputs, w, b) for w, b in zip(directions, phases, strict=True)))


@dataclass
class KernelModel:
    """A fitted classifier: means and scales of the inputs, the map, weights and intercept."""

    names: list[str]
    means: np.ndarray
    scales: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    intercept: float

    def inputs(self) -> list[Column]:
        """Standardised inputs; a missing one counts as its mean."""
        return [F.coalesce(F.when(F.isnan(n), None).otherwise((F.col(n) - float(m)) / float(s)), F.lit(0.0)) for n, m, s in zip(self.names, self.means, self.scales, strict=True)]

    def score(self) -> Column:
        """The probability of a positive, as an expression over the inputs."""
        scale = float(np.sqrt(2 / len(self.phases)))
        z = F.lit(float(self.intercept))
        for w, b, weight in zip(self.directions, self.phases, self.weights, strict=True):
            z = z + wave(self.inputs(), w, b) * float(weight * scale)
        return logistic(z)


def fit_kernel(df: DataFrame, names: list[str], positive: str, gamma: float, size: int = 128, ridge: float = 1e-3, seed: int = 0, weight: str | None = None) -> KernelModel:
    """A logistic model over the kernel's features of standardised inputs, fitted over all rows by distributed passes.

    Rows without ``positive`` take no part; an input that never varies has scale 1.
    """
    rows = df.where(F.col(positive).isNotNull())
    value = lambda n: F.when(~F.isnan(n), F.col(n))
    sums = rows.agg(*(f(value(n)).alias(f"{p}{i}") for i, n in enumerate(names) for p, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    means, scales = (np.array([sums[f"{p}{i}"] or d for i in range(len(names))], float) for p, d in (("m", 0.0), ("s", 1.0)))
    directions, phases = frequencies(len(names), size, gamma, seed)
    model = KernelModel(names, means, scales, directions, phases, np.zeros(size), 0.0)
    made = rows.select(F.col(positive).cast("double").alias("label"), (F.lit(1.0) if weight is None else F.col(weight)).alias("weight"), array_to_vector(fourier(model.inputs(), directions, phases)).alias("features"))
    fitted = LogisticRegression(regParam=ridge, standardization=False, weightCol="weight").fit(made)
    model.weights, model.intercept = fitted.coefficients.toArray(), float(fitted.intercept)
    return model
