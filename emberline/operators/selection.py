"""Greedy selection, top-k and tie rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def greedy_separated(df: DataFrame, score: str, clip: str = "clip", frame: str = "frame", most: int = 3, apart: int = 20, above: float | None = None) -> DataFrame:
    """Frames of each clip by descending score, ties by frame, each at least
    ``apart`` from those chosen before it; ``rank`` from 1."""
    rows = df if above is None else df.where(F.col(score) > above)
    best = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("k"), F.col(frame).alias("frame"))))
    empty = F.array().cast("array<struct<k:double,frame:int>>")
    chosen = F.aggregate(
        best, empty,
        lambda a, x: F.when((F.size(a) < most) & ~F.exists(a, lambda c: F.abs(c["frame"] - x["frame"]) < apart), F.concat(a, F.array(F.struct(x["k"].cast("double").alias("k"), x["frame"].cast("int").alias("frame"))))).otherwise(a),
    )
    out = rows.groupBy(clip).agg(chosen.alias("c")).select(clip, F.posexplode("c"))
    return out.select(clip, (F.col("pos") + 1).alias("rank"), F.col("col.frame").alias(frame), (-F.col("col.k")).alias(score))


def top_k(df: DataFrame, k: int, groups: list[str], *order) -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= k)


def latest(df: DataFrame, name: str) -> DataFrame:
    """The greatest name in the order of numeric strings: by length, then text."""
    return df.agg(F.max_by(name, F.struct(F.length(name), F.col(name))).alias("latest"))


def short_proposals(df: DataFrame, score: str, originals: DataFrame, clear: int = 3, apart: int = 10, most: int = 4) -> DataFrame:
    """Greedy picks with a positive score that lie clear of a clip's original frames."""
    own = originals.groupBy("clip").agg(F.collect_list("frame").alias("_o"))
    free = df.join(own, "clip", "left").where(F.col("_o").isNull() | ~F.exists("_o", lambda o: F.abs(o - F.col("frame")) < clear))
    return greedy_separated(free, score, most=most, apart=apart, above=0.0)
