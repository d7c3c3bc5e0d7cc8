"""Model studies: tabular families by fold, hard-EM and boosted-tree bags, ablation,
leakage audit and stress matrices."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed
from .learn import instance_supervision
from .vectors import fit_scaler, standardise

#: Estimators by name; each call makes a new one.
FAMILIES: dict[str, Callable] = {
    "logistic": lambda: LogisticRegression(regParam=0.01, weightCol="weight"),
    "forest": lambda: RandomForestClassifier(numTrees=100, maxDepth=3, minInstancesPerNode=3, weightCol="weight", seed=1),
    "boosted": lambda: GBTClassifier(maxIter=20, maxDepth=2, stepSize=0.1, weightCol="weight", seed=1),
}


def fit(df: DataFrame, features: Sequence[str], family: str, label: str = "label"):
    """A fitted pipeline over named columns; ``df`` has weights."""
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), FAMILIES[family]().setFeaturesCol("_x").setLabelCol(label)]).fit(df)


def score(model, df: DataFrame, to: str = "score") -> DataFrame:
    return model.transform(df).withColumn(to, vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def cross_validated(df: DataFrame, folds: DataFrame, features: Sequence[str], family: str, clip: str = "clip") -> DataFrame:
    """Held-out scores: for each fold, preprocessing and model fitted on its training
    clips only, applied to its test clips.  Folds are few; each is a Spark job."""
    out = None
    for row in folds.select("thread").distinct().orderBy("thread").collect():
        own = folds.where(F.col("thread") == row.thread)
        train = df.join(own.where("role = 'train'").select(clip), clip, "left_semi")
        test = df.join(own.where("role = 'test'").select(clip), clip, "left_semi")
        fitted = checkpointed(fit_scaler(train, features, "weight"))
        held = score(fit(standardise(train, fitted, features), features, family), standardise(test, fitted, features)).withColumn("thread", F.lit(row.thread))
        out = held if out is None else out.unionByName(held)
    if out is None:
        raise ValueError("no folds")
    return out


def hard_em(df: DataFrame, features: Sequence[str], family: str = "logistic", rounds: int = 3, clip: str = "clip", order: str = "frame"):
    """Bags by turns: fit known windows, then take each untimed positive bag's best
    window as positive, and fit again."""
    known = df.where("target >= 0").withColumn("label", F.col("target").cast("double")).withColumn("weight", F.lit(1.0))
    untimed = df.where("positive").join(df.where("positive and target = 1").select(clip).distinct(), clip, "left_anti")
    model = fit(known, features, family)
    for _ in range(rounds):
        w = Window.partitionBy(clip).orderBy(F.col("score").desc(), order)
        best = score(model, untimed).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "score")
        rest = known.join(best.select(clip, order), [clip, order], "left_anti")
        model = fit(checkpointed(rest.unionByName(best.withColumn("label", F.lit(1.0)).withColumn("weight", F.lit(1.0)))), features, family)
    return model


def tree_bags(df: DataFrame, features: Sequence[str], rounds: int = 2, mass: float = 0.75, k: int = 3):
    """Boosted trees under instance supervision; ``p`` of the first round is given by
    a simpler model, later rounds use the trees' own."""
    now = df
    model = None
    for _ in range(rounds):
        taught = instance_supervision(now, mass, k).where("y >= 0 and weight > 0").withColumn("label", F.col("y").cast("double"))
        model = fit(checkpointed(taught), features, "boosted")
        now = score(model, df.drop("p"), "p")
    return model


def ablation(df: DataFrame, groups: dict[str, Sequence[str]], measure: Callable[[DataFrame, list[str]], float]) -> list[tuple[str, float]]:
    """A study's figure with all columns, and without each group in turn."""
    everything = [c for g in groups.values() for c in g]
    return [("all", measure(df, everything)), *((f"without {name}", measure(df, [c for c in everything if c not in set(own)])) for name, own in groups.items())]


def masked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Disabled features as zeros, so that schemas stay."""
    return df.withColumns({c: F.lit(0.0) for c in columns})


def assert_unused(model, features: Sequence[str], disabled: Sequence[str]) -> None:
    """The disabled ones among a fitted pipeline's features must have no coefficient, or
    take part in no split."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else last.coefficients.toArray()
    own = dict(zip(features, values, strict=True))
    if missing := [n for n in disabled if n not in own]:
        raise ValueError(f"no features: {', '.join(missing)}")
    if used := [n for n in disabled if own[n] != 0]:
        raise ValueError(f"disabled features are used: {', '.join(used)}")


def audit(claimed: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows on one side only, with the side that has them."""
    both = [c for c in claimed.columns if c in recomputed.columns]
    a, b = claimed.select(*both), recomputed.select(*both)
    return a.exceptAll(b).withColumn("only", F.lit("claimed")).unionByName(b.exceptAll(a).withColumn("only", F.lit("recomputed")))


def stress(clips: DataFrame, delays: Sequence[float], gains: Sequence[float], codecs: Sequence[str]) -> DataFrame:
    """Every clip under every recipe; the recipes are a small declared list."""
    recipe = F.explode(F.array(*(F.struct(F.lit(float(d)).alias("delay_s"), F.lit(float(g)).alias("gain_db"), F.lit(c).alias("codec")) for d in delays for g in gains for c in codecs)))
    return clips.withColumn("r", recipe).select(*clips.columns, "r.*")


def importance(model, features: Sequence[str], most: int = 15) -> list[tuple[str, float]]:
    """The strongest features of a fitted tree family or linear model."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    return sorted(zip(features, map(float, values), strict=True), key=lambda x: (-x[1], x[0]))[:most]
