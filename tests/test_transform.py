"""Exact quantiles and the two-part transform against NumPy, in any partitioning."""

import json
import math

import numpy as np
import pytest

from emberline.operators import transform as T
from emberline.operators.quantiles import exact_quantiles, from_bits, ordered_bits


def test_bits_keep_order():
    x = np.array([-math.inf, -1e300, -2.0, -1e-300, -0.0, 0.0, 5e-324, 1.0, 1 + 2**-52, 1e300, math.inf])
    assert np.all(np.diff(ordered_bits(x).astype(object)) > 0)
    assert [from_bits(int(b)) for b in ordered_bits(x)] == x.tolist()


def test_quantiles(spark):
    r = np.random.default_rng(1)
    a = np.concatenate([r.normal(size=300) * 1e6, [0.0] * 57, -r.random(40)])
    b = np.where(r.random(len(a)) < 0.3, np.nan, np.round(r.normal(size=len(a)), 1))
    rows = [(float(x), None if i % 11 == 0 else float(y), 3, None) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c int, d double")
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    kept = [y for i, y in enumerate(b) if i % 11 and not math.isnan(y)]
    for parts in (1, 6):
        got = exact_quantiles(df.repartition(parts), ["a", "b", "c", "d"], shares)
        assert got["a"] == pytest.approx(np.quantile(a, shares).tolist(), rel=1e-12) and got["b"] == pytest.approx(np.quantile(kept, shares).tolist(), rel=1e-12)
        assert got["c"] == [3.0] * 5 and got["d"] == [None] * 5
    assert exact_quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]}


def test_two_part(spark):
    r = np.random.default_rng(2)
    n = 500
    x = r.normal(size=(n, 3)) * [1, 1e4, 0] + [0, 1e7, 2]
    x[r.random(n) < 0.2, 0] = np.nan
    v = r.normal(size=(n, 6)) @ r.normal(size=(6, 6))
    w = r.random(n) + 0.1
    rows = [(i, *map(float, x[i]), v[i].tolist(), float(w[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, v array<double>, w double")
    model = T.fit_two_part(df, "id", ["a", "b", "c"], "v", 3, "w")
    filled = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    mean = np.average(filled, axis=0, weights=w)
    scale = np.sqrt(np.average((filled - mean) ** 2, axis=0, weights=w))
    scale[2] = 1
    values, vectors = np.linalg.eigh(np.cov(v.T))
    lead = vectors[:, ::-1][:, :3].T
    parts = (v - v.mean(axis=0)) @ lead.T
    parts *= np.sign((lead * np.array(model.components)).sum(axis=1))
    pm = np.average(parts, axis=0, weights=w)
    want = np.clip(np.column_stack([(filled - mean) / scale, (parts - pm) / np.sqrt(np.average((parts - pm) ** 2, axis=0, weights=w))]), -8, 8)
    again = T.TwoPart(**json.loads(json.dumps(model.as_dict())))
    got = {q.id: q for q in T.two_part(df.drop("w"), again, "v", ["id"]).collect()}
    assert again.names() == ["a", "b", "c", "component_0", "component_1", "component_2"]
    assert np.allclose([[got[i][c] for c in again.names()] for i in range(n)], want, atol=1e-7)
    # any partitioning gives the same parameters, also of a sample
    fits = [T.fit_two_part(df.repartition(k), "id", ["a", "b", "c"], "v", 2, "w", sample=100) for k in (1, 5)]
    assert fits[0].components == fits[1].components and fits[0].medians == fits[1].medians and fits[0].centre == fits[1].centre
    assert fits[0].means == pytest.approx(fits[1].means, rel=1e-12) and fits[0].part_scales == pytest.approx(fits[1].part_scales, rel=1e-9)
    assert np.allclose(np.abs(np.array(fits[0].components) @ np.array(fits[0].components).T), np.eye(2))
    odd = spark.createDataFrame([(1, None, 1e300, 2.0, None)], "id long, a double, b double, c double, v array<double>")
    r = T.two_part(odd, again, "v", ["id"]).first()
    assert r.b == 8.0 and r.a == pytest.approx((model.medians[0] - model.means[0]) / model.scales[0])
    with pytest.raises(ValueError):
        T.fit_two_part(df.limit(0), "id", ["a"], "v")
