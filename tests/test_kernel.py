"""Random Fourier features against kernel values, and a classifier that no line can be."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import kernel as K


@pytest.mark.parametrize("gamma", [0.1, 0.7])
def test_kernel_values(gamma):
    size = 1024
    w, b = K.frequencies(3, size, gamma, 5)
    x = np.random.default_rng(1).normal(size=(60, 3))
    z = np.sqrt(2 / size) * np.cos(x @ w.T + b)
    exact = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - exact).max() < 4 / np.sqrt(size)
    assert np.array_equal(w[:100], K.frequencies(3, 100, gamma, 5)[0])


def test_map_is_the_expression(spark):
    w, b = K.frequencies(2, 16, 0.5, 2)
    x = np.random.default_rng(2).normal(size=(20, 2))
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, c double")
    got = np.array([r.z for r in df.select(K.fourier([F.col("a"), F.col("c")], w, b).alias("z")).collect()])
    assert np.allclose(got, np.sqrt(2 / 16) * np.cos(x @ w.T + b))


def test_ring(spark):
    r = np.random.default_rng(3)
    x = r.uniform(-2, 2, size=(800, 2))
    y = (x**2).sum(axis=1) < 1.6
    rows = [(i, float(10 * a + 3), float(c), bool(t)) for i, ((a, c), t) in enumerate(zip(x, y, strict=True))] + [(-1, None, float("nan"), None)]
    df = spark.createDataFrame(rows, "id int, a double, c double, y boolean")
    model = K.fit_kernel(df.where("id < 600"), ["a", "c"], "y", 1.0, 64)
    got = {r.id: r.p for r in df.select("id", model.score().alias("p")).collect()}
    held = [i for i in range(600, 800)]
    assert np.mean([(got[i] > 0.5) == y[i] for i in held]) > 0.9
    z = np.sqrt(2 / 64) * np.cos(((np.array([[10 * a + 3, c] for a, c in x]) - model.means) / model.scales) @ model.directions.T + model.phases)
    assert [got[i] for i in range(800)] == pytest.approx((1 / (1 + np.exp(-(z @ model.weights + model.intercept)))).tolist())
    assert 0 < got[-1] < 1
    again = K.fit_kernel(df.where("id < 600").repartition(7), ["a", "c"], "y", 1.0, 64)
    assert again.weights == pytest.approx(model.weights, abs=1e-4)
