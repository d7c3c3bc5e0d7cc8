import numpy as np
import pandas as pd

from emberline.operators import models, signal


def bags(spark):
    r = np.random.default_rng(7)
    rows = []
    for clip in range(40):
        positive = clip % 2 == 0
        for frame in range(6):
            event = positive and frame == clip % 6
            target = (1 if event else -1) if positive and clip % 4 == 0 else -1 if positive else 0
            rows.append((clip, frame, clip % 4, positive, target, float(r.normal() + 4 * event), float(r.normal()), 0.5))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["clip", "frame", "thread", "positive", "target", "x", "noise", "p"]))


def pooled_gap(scored):
    top = scored.groupBy("clip", "positive").agg({"score": "max"}).toPandas()
    return top[top.positive]["max(score)"].mean() - top[~top.positive]["max(score)"].mean()


def test_bag_models_find_the_events(spark):
    df = bags(spark)
    for model in (models.hard_em(df, ["x", "noise"], rounds=1), models.tree_bags(df, ["x", "noise"], rounds=1)):
        assert pooled_gap(models.score(model, df)) > 0.2
        assert models.importance(model, ["x", "noise"])[0][0] == "x"


def test_folds_are_fitted_apart(spark):
    from pyspark.sql import functions as F

    df = bags(spark).withColumn("label", F.col("positive").cast("double")).withColumn("weight", F.lit(1.0))
    clips = df.select("clip", "thread").distinct()
    folds = clips.select("thread", "clip", F.lit("test").alias("role")).where("thread < 2").unionByName(clips.select(F.lit(0).cast("long").alias("thread"), "clip", F.lit("train").alias("role")).where("clip % 4 <> 0")).unionByName(clips.select(F.lit(1).cast("long").alias("thread"), "clip", F.lit("train").alias("role")).where("clip % 4 <> 1"))
    out = models.cross_validated(df, folds, ["x", "noise"], "logistic")
    assert out.count() == 20 * 6 and out.where("score is null or score < 0 or score > 1").count() == 0


def test_audit_stress_and_ablation(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert sorted((r.k, r.only) for r in models.audit(a, b).collect()) == [(1, "claimed"), (2, "claimed"), (3, "recomputed")]
    assert models.stress(a, [0, 1], [-6, 0, 6], ["x", "y"]).count() == 3 * 12
    assert models.ablation(a, {"u": ["a", "b"], "v": ["c"]}, lambda _, c: float(len(c))) == [("all", 3.0), ("without u", 1.0), ("without v", 2.0)]
    assert models.masked(a, ["k"]).distinct().count() == 1


def test_recording_kernels():
    r = np.random.default_rng(2)
    x = r.normal(size=16000) * 0.01
    x[8000:12800] += np.sin(2 * np.pi * 1500 * np.arange(4800) / 16000)
    whole = signal.landmarks(x)
    assert whole == signal.landmarks(x, chunk=17) and len(whole) > 50
    shifted = {t for t, _ in signal.landmarks(np.concatenate([np.zeros(1600), x]))}
    assert len({t for t, _ in whole} & shifted) > 0.8 * len({t for t, _ in whole})
    crops = signal.context_crops(np.ones(20000) * 2, 1000)
    assert crops["before"].max() <= 1 and (crops["before"][:14600] == 0).all() and crops["event"].min() == 1
    mixed = signal.mix_event(np.zeros(1000), np.ones(500), 800, 0.0)
    assert len(mixed) == 1000 and mixed[900] == 1 and mixed[:800].max() == 0
