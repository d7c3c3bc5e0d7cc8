"""Leakage-safe grouped and nested folds, and eligibility of derived records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed, families


def grouped_folds(clips: DataFrame, links: DataFrame) -> DataFrame:
    """``thread, clip, role``: for each held-out thread the clips it tests, those
    whose fold thread it is, and those it may train on: clips of no family that
    has a clip in that thread.

    ``clips(clip, thread, fold_thread)`` has a row for each thread of a clip.
    The threads that bar a family lie beside it, so that the rows of each thread
    and clip, which are the result, are made where the clip is and never shuffled.
    """
    family = families(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "clip")
    named = checkpointed(clips.join(family, "clip", "left").withColumn("family", F.coalesce("family", "clip")))
    barred = named.groupBy("family").agg(F.collect_set("thread").alias("barred"))
    threads = named.select(F.col("fold_thread").alias("thread")).distinct()
    one = named.select("clip", "fold_thread", "family").distinct()
    test = one.select(F.col("fold_thread").alias("thread"), "clip", F.lit("test").alias("role"))
    free = (F.col("thread") != F.col("fold_thread")) & ~F.array_contains("barred", F.col("thread"))
    train = one.join(barred, "family").join(F.broadcast(threads), free).select("thread", "clip", F.lit("train").alias("role"))
    return test.unionByName(train)


def nested_folds(folds: DataFrame) -> DataFrame:
    """``outer, inner, clip, role``: inner folds within an outer fold's training clips."""
    allowed = folds.where("role = 'train'").select(F.col("thread").alias("outer"), "clip")
    inner = folds.select(F.col("thread").alias("inner"), "clip", "role")
    return allowed.join(inner, "clip").where("outer <> inner").select("outer", "inner", "clip", "role")


def fold_faults(folds: DataFrame) -> DataFrame:
    """Clips that are not tested exactly once, or are in both roles of one fold."""
    tested = folds.groupBy("clip").agg(F.sum(F.when(F.col("role") == "test", 1).otherwise(0)).alias("tests")).where("tests <> 1").select("clip", F.lit("tested").alias("fault"))
    both = folds.groupBy("thread", "clip").agg(F.count_distinct("role").alias("roles")).where("roles > 1").select("clip", F.lit("both").alias("fault"))
    return tested.unionByName(both)


def eligible(records: DataFrame, train: DataFrame, augment: bool = True) -> DataFrame:
    """Records that may train: not for evaluation, labelled, base unless ``augment``,
    and all their parents among ``train(clip)``."""
    known = records.where((F.col("split") != "evaluation") & F.col("label").isin("positive", "negative") & (F.lit(augment) | (F.col("split") == "base")))
    strays = known.select("key", F.explode("parents").alias("clip")).join(train.select("clip"), "clip", "left_anti").select("key").distinct()
    return known.join(strays, "key", "left_anti")
