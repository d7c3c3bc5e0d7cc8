import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from emberline.functions import scalars as S
from emberline.operators import features, folds, graph, labels, learn, matching, media, metrics, pooling, selection, signal, vectors


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_tier_boundaries(spark):
    scores = [0.0, 0.59999, 0.6, 0.79999, 0.8, 1.0, None, math.nan, -1.0]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "i int, s double")
    got = [r.t for r in df.select("i", S.risk_tier(F.col("s")).alias("t")).orderBy("i").collect()]
    assert got == ["low", "low", "maybe", "maybe", "alert", "alert", "unknown", "unknown", "unknown"]


def test_tokens_pack_and_unpack(spark):
    token = S.pack_token(F.lit(300), F.lit(47), F.lit(9))
    low, high, gap = S.unpack_token(token)
    assert tuple(one(spark, token, low, high, gap)) == ((100 << 18) | (15 << 9) | 4, 100, 15, 4)


def test_flatten_threads(spark):
    payloads = ['{"threads":[{"posts":[{"files":[{"path":"/b/src/1/a.mp4","md5":"x","size":3}]},{"files":null}]}]}', '[{"path":"/b/src/1/b.webm"}]']
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "k int, payload string")
    flat = media.flatten_threads(df)
    assert {(r.k, r.path) for r in flat.collect()} == {(0, "/b/src/1/a.mp4"), (1, "/b/src/1/b.webm")}
    kept = {r.file: r for r in media.normalize_media(flat).collect()}
    assert kept["a.mp4"].source_bytes == 3072 and kept["a.mp4"].thread == "1" and kept["b.webm"].status == "ok"
    with pytest.raises(PySparkException):
        media.flatten_threads(spark.createDataFrame([(1, '"text"')], "k int, payload string")).collect()


IV = "array<struct<start_s:double,end_s:double>>"


def test_window_targets(spark):
    """The table of the fixture: label, timed, window, clip's duration, target."""
    rows = [("positive", None, 10.2, 10.5, 20.0, -1), ("positive", [(10.0, 12.0)], 10.02, 10.32, 20.0, -1), ("positive", [(10.0, 12.0)], 10.1, 10.4, 20.0, 1), ("positive", [(10.0, 12.0)], 9.0, 9.3, 20.0, -1), ("positive", [(10.0, 12.0)], 0.0, 0.3, 20.0, 0), ("negative", None, 10.2, 10.5, 20.0, 0), ("unlabeled", None, 10.2, 10.5, 20.0, -1), ("positive", [(10.0, 12.0)], 11.7, 12.0, 12.0, 1)]
    df = spark.createDataFrame(rows, f"label string, i {IV}, a double, b double, d double, want int")
    out = df.select("want", labels.window_target(F.col("label"), F.col("i"), F.col("a"), F.col("b"), F.col("d")).alias("got")).collect()
    assert [r.got for r in out] == [r.want for r in out]


def test_interval_rules(spark):
    cases = [([], False), ([(-1.0, 2.0)], False), ([(1.0, 1.0)], False), ([(math.nan, 2.0)], False), ([(1.0, 3.0), (2.0, 4.0)], False), ([(1.0, 30.0)], False), ([(1.0, 2.0), (2.0, 3.0)], True), ([(0.0, 10.0005)], True)]
    df = spark.createDataFrame([(i, c, w) for i, (c, w) in enumerate(cases)], f"k int, i {IV}, want boolean")
    assert all(r.want == r.got for r in df.select("want", labels.valid_intervals(F.col("i"), F.lit(10.0)).alias("got")).collect())


def test_conflicting_copies_raise(spark):
    df = spark.createDataFrame([("a", "positive", "/1", "t"), ("a", "negative", "/2", "t")], "digest string, label string, path string, thread string")
    with pytest.raises(PySparkException):
        labels.collapse_labelled(df).collect()


def test_pooling_and_weights(spark):
    df = spark.createDataFrame([(0, 0, 0.2), (0, 1, 0.8), (1, 0, 0.6)], "clip int, frame int, p double")
    got = {r.clip: r.s for r in df.groupBy("clip").agg(pooling.linear_softmax(F.col("p")).alias("s")).collect()}
    assert abs(got[0] - 0.68) < 1e-12 and abs(got[1] - 0.6) < 1e-12
    bag = spark.createDataFrame([(0, p) for p in (0.92, 0.43, 0.24, 0.05)], "clip int, p double").agg(pooling.power_pool(F.col("p"), 2).alias("a"), pooling.power_pool(F.col("p"), 8).alias("b")).first()
    assert bag.a < 0.8 and 0.9 < bag.b <= 0.92
    w = spark.createDataFrame([(0, 1), (0, 1), (0, 1), (1, 1), (2, 0), (3, 0)], "clip int, target int")
    weights = pooling.clip_weights(w).toPandas()
    assert np.isclose(weights[weights["clip"] == 0].weight.sum(), weights[weights["clip"] == 1].weight.sum()) and np.isclose(*weights.groupby("target").weight.sum())
    with pytest.raises(PySparkException):
        pooling.clip_weights(w.where("target = 1")).collect()
    hard = spark.createDataFrame([(0, i, p) for i, p in enumerate((0.1, 0.9, 0.2, 0.8, 0.3, 0.7))], "clip int, frame int, p double")
    assert [r.weight for r in pooling.hard_negative_weights(hard, 1.0, 1).orderBy("frame").collect()] == [0, 1, 0, 0, 0, 0]


def test_source_and_donor_weights(spark):
    rows = [("real", "positive", "a"), ("real", "positive", "a"), ("real", "positive", "b"), ("real", "negative", "c"), ("synthetic", "positive", "a"), ("synthetic", "negative", "d")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, kind string, label string, source string")
    assert [round(r.weight, 9) for r in pooling.source_weights(df, {"real": 1.0, "synthetic": 0.2}).orderBy("i").collect()] == [0.125, 0.125, 0.25, 0.5, 0.1, 0.1]
    donors = spark.createDataFrame([(True, "positive", "x", 0.5 + k % 2) for k in range(10)] + [(False, "positive", "a", 9.0), (False, "positive", "a", 9.0), (False, "positive", "b", 9.0), (False, "negative", "c", 9.0)], "real boolean, label string, donor string, own double")
    sums = {(r.real, r.label): r.s for r in pooling.donor_weights(donors).groupBy("real", "label").agg(F.sum("weight").alias("s")).collect()}
    assert abs(sums[True, "positive"] - 8) < 1e-9 and abs(sums[False, "positive"] - 1) < 1e-9 and abs(sums[False, "negative"] - 1) < 1e-9
    assert pooling.donor_weights(donors.where("real or label = 'positive'")).where("weight is not null").count() == 0


def test_average_precision_and_auc_against_pairs(spark):
    r = np.random.default_rng(3)
    y, s = r.random(80) < 0.4, np.round(r.random(80), 1)
    df = spark.createDataFrame(pd.DataFrame({"positive": y, "score": s}))
    order = np.unique(s)[::-1]
    tp = np.array([(y & (s >= t)).sum() for t in order])
    n = np.array([(s >= t).sum() for t in order])
    ap = (np.diff(np.concatenate([[0], tp])) / y.sum() * tp / n).sum()
    auc = np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a in s[y] for b in s[~y]])
    assert abs(metrics.average_precision(df).first()[0] - ap) < 1e-12 and abs(metrics.roc_auc(df).first()[0] - auc) < 1e-12
    assert metrics.average_precision(df.where("not positive")).first()[0] is None and metrics.roc_auc(df.where("positive")).first()[0] is None


def test_greedy_separation_against_a_loop(spark):
    r = np.random.default_rng(5)
    rows = [(c, f, round(float(r.random()), 1)) for c in range(5) for f in range(120)]
    got = selection.greedy_separated(spark.createDataFrame(rows, "clip int, frame int, score double"), "score", most=4, apart=15).collect()
    for c in range(5):
        chosen = []
        for _, f, _ in sorted((x for x in rows if x[0] == c), key=lambda x: (-x[2], x[1])):
            if len(chosen) < 4 and all(abs(f - g) >= 15 for g in chosen):
                chosen.append(f)
        assert [x.frame for x in sorted((x for x in got if x.clip == c), key=lambda x: x.rank)] == chosen


def test_families_and_folds(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "src string, dst string")
    assert {r.node: r.family for r in graph.families(edges).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert {r.node for r in graph.reachable(spark.createDataFrame([("c",)], "node string"), edges).collect()} == {"a", "b", "c"}
    clips = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 3, 3), ("d", 4, 4)], "clip string, thread int, fold_thread int")
    links = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    out = folds.grouped_folds(clips, links)
    held = out.where("thread = 1").collect()
    assert {r.clip for r in held if r.role == "train"} == {"d"} and {r.clip for r in held if r.role == "test"} == {"a"}
    assert folds.fold_faults(out).count() == 0


def test_index_match_slack_stays_in_its_bits(spark):
    q = spark.createDataFrame([(1, 511, 0), (1, 512, 5)], "query int, token long, frame int")
    p = spark.createDataFrame([(7, 510, 1), (7, 511, 2), (7, 512, 3), (7, 513, 4)], "reference int, token long, frame int")
    got = {(r.anchor, r.at) for r in matching.index_match(q, p).collect()}
    assert got == {(0, 1), (0, 2), (5, 3), (5, 4)}


def slopes_agree(loss, theta):
    value, slope = loss(theta)
    for e in np.eye(len(theta)) * 1e-6:
        assert abs((loss(theta + e)[0] - loss(theta - e)[0]) / 2e-6 - slope[e > 0][0]) < 1e-5
    assert np.isfinite(value)


def test_gradients():
    r = np.random.default_rng(0)
    x, bag = r.normal(size=(12, 5)), np.array([0, 0, 0, 1, 1, 2, 2, 2, 3, 3, 3, 3])
    positive, wanted = np.array([1.0, 0, 1, 0]), r.integers(-1, 2, 12).astype(float)
    for power in (2.0, 8.0):
        loss = learn.bag_loss(x, bag, positive, wanted, 0.1, power)
        slopes_agree(loss, r.normal(size=6) * 0.3)
        assert loss(learn.minimise(loss, np.zeros(6)))[0] < loss(np.zeros(6))[0]


def test_gradients_of_the_further_terms():
    r = np.random.default_rng(6)
    x, bag = r.normal(size=(14, 4)), np.repeat([0, 1, 2, 3, 4], [3, 3, 3, 3, 2])
    positive, wanted = np.array([1.0, 1, 0, 0, 1]), r.integers(-1, 2, 14).astype(float)
    mass, pair, trust = r.random(5) + 0.1, np.array([0, 0, 1, 1, 2]), r.random(14)
    made = (r.normal(size=(6, 4)), (r.random(6) < 0.5).astype(float), r.random(6), 0.2)
    theta = r.normal(size=5) * 0.4
    for how in ({"trust": trust}, {"pair": pair, "agree": 0.7}, {"extra": made}, {"pair": pair, "agree": 0.7, "extra": made}):
        slopes_agree(learn.bag_loss(x, bag, positive, wanted, None, 4.0, mass=mass, **how), theta)
    # by hand: the pooled bags, their entropy, known windows, pairs' means, and the penalty's default
    z = x @ theta[:-1] + theta[-1]
    p = 1 / (1 + np.exp(-z))
    q = np.array([(p[bag == k] ** 4).sum() / (p[bag == k] ** 3).sum() for k in range(5)])
    value = -sum(m * np.log(v if y else 1 - v) for m, v, y in zip(mass, q, positive, strict=True)) + 0.5 * (20 / 5) * (theta @ theta)
    value -= 0.25 * sum(0.5 / (wanted == w).sum() * np.log(v if w else 1 - v) for v, w in zip(p, wanted, strict=True) if w >= 0)
    assert learn.bag_loss(x, bag, positive, wanted, None, 4.0, mass=mass)(theta)[0] == pytest.approx(value)
    off = [q[k] - sum(mass[j] * q[j] for j in range(5) if pair[j] == pair[k]) / sum(mass[j] for j in range(5) if pair[j] == pair[k]) for k in range(5)]
    value += 0.7 * sum(w * d * d for w, d in zip(mass, off, strict=True))
    own, state, weight, strength = made
    other = own @ theta[:-1] + theta[-1]
    value += strength * sum(w / weight.sum() * np.log1p(np.exp(-o if s else o)) for o, s, w in zip(other, state, weight, strict=True))
    assert learn.bag_loss(x, bag, positive, wanted, None, 4.0, mass=mass, pair=pair, agree=0.7, extra=made)(theta)[0] == pytest.approx(value)


def test_a_positive_bag_needs_a_candidate(spark):
    df = spark.createDataFrame([(0, 0, 0.9, 0, True), (0, 1, 0.1, 0, True)], "clip int, frame int, p double, target int, positive boolean")
    with pytest.raises(PySparkException, match="known negative"):
        learn.instance_supervision(df).collect()


def test_supervision_of_a_positive_bag(spark):
    df = spark.createDataFrame([(0, i, p, t, True) for i, (p, t) in enumerate(zip((0.99, 0.7, 0.2, 0.1), (0, -1, 1, -1), strict=True))], "clip int, frame int, p double, target int, positive boolean")
    got = learn.instance_supervision(df, known_negative=0.1).orderBy("frame").collect()
    assert [r.y for r in got] == [0, 1, 1, -1] and [round(r.weight, 9) for r in got] == [0.1, 0.5, 0.5, 0.0]


def test_policy_keeps_what_the_baseline_caught(spark):
    rows = [(c, i, k, k < 2, s) for i, (c, scores) in enumerate({"base": (0.9, 0.85, 0.9, 0.9, 0.1, 0.1), "swaps": (0.9, 0.1, 0.1, 0.1, 0.1, 0.1), "better": (0.9, 0.85, 0.3, 0.3, 0.1, 0.1)}.items()) for k, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "candidate string, candidate_order int, clip int, positive boolean, score double")
    assert learn.select_policy(df, "base", [0.7, 0.8]).first().candidate == "better"
    assert learn.select_policy(df.where("candidate <> 'better'"), "base", [0.7, 0.8]).first().candidate == "base"


def test_trees_and_scaler(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    r = np.random.default_rng(2)
    pdf = pd.DataFrame(r.uniform(-2, 2, (400, 3)), columns=["a", "b", "c"])
    pdf["label"] = np.where(pdf.a > 0.3, pdf.b, -pdf.c)
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(pdf))
    model = DecisionTreeRegressor(maxDepth=3).fit(df)
    nodes = [{**n, "feature": None if n["feature"] is None else "abc"[n["feature"]]} for n in learn.export_tree(model)]
    out = model.transform(df).withColumn("own", vectors.tree_value(nodes))
    assert out.where(F.abs(F.col("own") - F.col("prediction")) > 1e-12).count() == 0
    holes = spark.createDataFrame([(1.0, 1.0), (None, 1.0), (4.0, 2.0), (math.nan, 2.0)], "x double, w double")
    f = vectors.fit_scaler(holes.withColumn("x", F.nanvl("x", F.lit(None))), ["x"], "w").first()
    x, w = np.array([1, 2.5, 4, 2.5]), np.array([1, 1, 2, 2])
    assert f.x_median == 2.5 and abs(f.x_mean - np.average(x, weights=w)) < 1e-12 and abs(f.x_scale - np.sqrt(np.average((x - f.x_mean) ** 2, weights=w))) < 1e-12


def test_signal_kernels():
    r = np.random.default_rng(1)
    x = r.normal(size=(2, 4000)).astype(np.float32) * 0.1
    assert (signal.read_wav(signal.write_wav(x)) == x).all()
    whole, blocks = signal.weighted(x, block=10**6), signal.weighted(x, block=700)
    assert np.abs(whole - blocks).max() < 1e-12
    t = np.arange(16000) / 16000
    share, depth = features.modulation(((1 + np.sin(2 * np.pi * 70 * t)) * np.sin(2 * np.pi * 1000 * t))[:, None])
    assert share > 0.9 and depth > 0.5 and np.isnan(features.modulation(np.zeros((100, 1)))).all() and features.modulation(np.zeros((16000, 1))) == (0.0, 0.0)
    y = np.concatenate([np.zeros(37), x[0]])
    assert signal.delay(x[0].astype(float), y, 40, 10) == 37
    trimmed, n = signal.canonical(np.concatenate([np.zeros((2, 50), np.float32), x], axis=1), 10)
    assert n == 50 and trimmed.shape[1] == 4010
    with pytest.raises(ValueError):
        signal.bounded(np.full((1, 3), np.nan))
    s = signal.frame_shares(x, 800, 1024)
    assert np.allclose(s.sum(axis=1), 1) and signal.flux(s)[0] == 0 and signal.frame_shares(x[:, :10]).shape == (1, 513)


def test_cluster_bootstrap_is_repeatable(spark):
    r = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame({"thread": r.integers(0, 6, 200), "label": np.where(r.random(200) < 0.5, "positive", "negative"), "before": r.random(200), "after": r.random(200)}))
    a, b = (tuple(metrics.cluster_bootstrap(df.repartition(n), "thread", draws=50).first()) for n in (1, 5))
    assert a == b and a[1] <= a[2]
