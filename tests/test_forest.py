"""Extremely randomised trees against trees grown node by node over all rows in NumPy."""

import numpy as np
import pytest

from emberline.operators import forest as T


def alone(x, y, w, seed, tree, depth, k, least):
    """One tree by recursion, with the same draws."""
    leaves, gains, splits = {}, np.zeros(x.shape[1]), {}

    def gini(rows):
        p = (w[rows] * y[rows]).sum() / w[rows].sum()
        return 2 * w[rows].sum() * p * (1 - p)

    def grow(node, rows, left):
        best = None
        p = (w[rows] * y[rows]).sum() / w[rows].sum()
        if left and 0 < p < 1:
            for f in T.drawn(seed, tree, np.array([node]), x.shape[1], k)[0].tolist():
                v = x[rows, f]
                if np.isnan(v).all() or not np.nanmax(v) > np.nanmin(v):
                    continue
                cut = T.cut_points(seed, tree, np.array([node]), np.array([[f]]), np.array([[np.nanmin(v)]]), np.array([[np.nanmax(v)]]))[0, 0]
                a, b = rows[~(v > cut)], rows[v > cut]
                if min(len(a), len(b)) >= least:
                    gain = gini(rows) - gini(a) - gini(b)
                    if best is None or gain > best[0] + 1e-12:
                        best = gain, f, cut, a, b
        if best is None:
            leaves[node] = p
            return
        gain, f, cut, a, b = best
        gains[f] += gain
        splits[node] = f, cut
        grow(2 * node, a, left - 1)
        grow(2 * node + 1, b, left - 1)

    grow(1, np.arange(len(x)), depth)
    return splits, leaves, gains


@pytest.mark.parametrize("least,weighted", [(1, False), (5, True)])
def test_against_numpy(spark, least, weighted):
    r = np.random.default_rng(least)
    x = np.round(r.normal(size=(400, 6)), 3)
    x[:, 5] = 1.0
    x[r.random(400) < 0.1, 2] = np.nan
    y = ((x[:, 0] + 0.5 * np.nan_to_num(x[:, 2]) + 0.3 * r.normal(size=400)) > 0).astype(float)
    w = np.round(r.random(400) + 0.1, 3) if weighted else np.ones(400)
    names = [f"f{i}" for i in range(6)]
    rows = [(i, *(None if np.isnan(v) else float(v) for v in x[i]), bool(y[i]), float(w[i])) for i in range(400)] + [(-1, *[9.0] * 6, None, 1.0)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} double" for n in names) + ", y boolean, w double").repartition(5)
    model = T.extra_trees(df, names, "y", "w" if weighted else None, trees=6, depth=5, most=3, least=least, seed=11)
    total, shares = np.zeros(400), []
    for t in range(6):
        splits, leaves, gains = alone(x, y, w, 11, t, 5, 3, least)
        assert {n: f for n, (f, _) in model.splits[t].items()} == {n: f for n, (f, _) in splits.items()}
        assert model.leaves[t] == pytest.approx(leaves) and model.gains[t] == pytest.approx(gains)
        shares.append(gains / gains.sum())
        total += [next(leaves[n] for n in walk(splits, v)) for v in x]
    assert list(model.importances().values()) == pytest.approx(np.mean(shares, axis=0)) and model.importances()["f5"] == 0
    got = {r.id: r.score for r in T.forest_scores(df, model, ["id"]).collect()}
    assert [got[i] for i in range(400)] == pytest.approx(total / 6) and -1 in got
    assert np.mean((total / 6 > 0.5) == (y > 0)) > 0.75


def walk(splits, v):
    node = 1
    while node in splits:
        f, cut = splits[node]
        node = 2 * node + (v[f] > cut)
    return [node]


def test_pure_and_empty(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True)], "x double, y boolean")
    model = T.extra_trees(df, ["x"], "y", trees=2)
    assert model.leaves == [{1: 1.0}] * 2 and model.importances() == {"x": 0.0}
    with pytest.raises(ValueError):
        T.extra_trees(df.limit(0), ["x"], "y")


def test_one_job_a_level(spark):
    df = spark.createDataFrame([(float(i % 17), float(i % 5), i % 3 == 0) for i in range(300)], "a double, b double, y boolean").repartition(3).persist()
    df.count()
    context, seen = spark.sparkContext, set()
    context.setJobGroup("forest", "forest")
    try:
        old = spark.conf.get("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        T.extra_trees(df, ["a", "b"], "y", trees=9, depth=3)
        seen = set(context.statusTracker().getJobIdsForGroup("forest"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
        context.setLocalProperty("spark.jobGroup.id", None)
        df.unpersist()
    assert len(seen) <= 4
