"""Windows to clips: pooling, and weights that copies cannot raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def max_pool(df: DataFrame, p: str = "p", clip: str = "clip", at: str = "frame") -> DataFrame:
    """Largest probability and the first window that has it."""
    return df.groupBy(clip).agg(F.max(p).alias("score"), F.min_by(at, F.struct(-F.col(p), F.col(at))).alias("event_at"))


def linear_softmax(p: Column) -> Column:
    return F.sum(p * p) / F.greatest(F.sum(p), F.lit(1e-12))


def power_pool(p: Column, power: float) -> Column:
    p = F.greatest(p, F.lit(1e-15))
    return F.sum(F.pow(p, F.lit(float(power)))) / F.greatest(F.sum(F.pow(p, F.lit(float(power - 1)))), F.lit(1e-300))


def clip_weights(df: DataFrame, clip: str = "clip", target: str = "target") -> DataFrame:
    """Each clip's windows share one unit; each class is then scaled to half the clips.

    A single class raises, as no balance exists.
    """
    unit = df.withColumn("_u", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(clip)))
    # clips and class sums are a row or two, added up before they are joined back
    clips = df.agg(F.count_distinct(clip).alias("_clips"))
    classes = unit.groupBy(target).agg(F.sum("_u").alias("_mass"))
    both = classes.crossJoin(F.broadcast(clips)).withColumn("_ok", F.assert_true(F.count(F.lit(1)).over(Window.partitionBy()) == 2, F.lit("weights need both classes")))
    return unit.join(F.broadcast(both.where(F.col("_ok").isNull()).drop("_ok")), target).withColumn("weight", F.col("_u") * F.col("_clips") / 2.0 / F.col("_mass")).drop("_u", "_clips", "_mass")


def source_weights(df: DataFrame, kind_mass: dict[str, float], kind: str = "kind", label: str = "label", source: str = "source") -> DataFrame:
    """Each kind's mass is halved between labels, split over their sources, then over copies."""
    counts = df.groupBy(kind, label, source).agg(F.count(F.lit(1)).alias("_copies"))
    # one row per source, so the window holds sources, not rows
    counts = counts.withColumn("_sources", F.count(F.lit(1)).over(Window.partitionBy(kind, label)))
    mass = F.coalesce(*(F.when(F.col(kind) == k, F.lit(m)) for k, m in kind_mass.items()), F.lit(0.0))
    return df.join(counts, [kind, label, source]).withColumn("weight", mass / 2.0 / F.col("_sources") / F.col("_copies")).drop("_copies", "_sources")


def donor_weights(df: DataFrame, own: str = "own", real: str = "real", label: str = "label", donor: str = "donor", share: float = 0.8) -> DataFrame:
    """Real rows keep ``share`` of their own weight; each class of synthetic rows gets
    the same part of the rest of the real rows' sum, split over donors, then copies;
    null weights where a class is missing."""
    totals = df.agg(F.sum(F.when(F.col(real), F.col(own).cast("double"))).alias("_real"), F.count_distinct(F.when(~F.col(real), F.col(label))).alias("_classes"))
    copies = df.where(~F.col(real)).groupBy(label, donor).agg(F.count(F.lit(1)).alias("_copies"))
    copies = copies.withColumn("_donors", F.count(F.lit(1)).over(Window.partitionBy(label)))
    held = df.join(copies, [label, donor], "left").crossJoin(F.broadcast(totals))
    synthetic = F.col("_real") * (1.0 - share) / 2.0 / F.col("_donors") / F.col("_copies")
    return held.withColumn("weight", F.when(F.col("_classes") < 2, F.lit(None)).when(F.col(real), share * F.col(own)).otherwise(synthetic)).drop("_real", "_classes", "_copies", "_donors")


def hard_negative_weights(df: DataFrame, mass: float, k: int, clip: str = "clip", p: str = "p", order: str = "frame") -> DataFrame:
    """Each negative clip's unit: ``mass`` on its ``k`` highest windows, the rest evenly on all."""
    own = Window.partitionBy(clip)
    n = F.count(F.lit(1)).over(own)
    hard = F.row_number().over(own.orderBy(F.col(p).desc(), order)) <= k
    return df.withColumn("weight", (1.0 - mass) / n + F.when(hard, mass / F.least(n, F.lit(k))).otherwise(0.0))


def conservative_threshold(df: DataFrame, score: str = "score", negative: str = "negative") -> DataFrame:
    """Just above the highest negative score, 1 without any; decide by ``>``."""
    top = F.max(F.when(F.col(negative), F.col(score)))
    return df.agg(F.coalesce(F.least(F.lit(1.0), top + 1e-9), F.lit(1.0)).alias("threshold"))
