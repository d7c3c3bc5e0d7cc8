"""Augmentation plans, and training bookkeeping of derived records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.scalars import hash_number, hash_uniform

# Codec profiles of training and of evaluation views.
TRAIN_PROFILES = [f"train-{i:02d}" for i in range(12)]
EVALUATION_PROFILES = ["evaluation-a", "evaluation-b", "evaluation-c"]


def plan(clips: DataFrame, backgrounds: DataFrame, positives: int = 12, others: int = 2, mixes: int = 4, seed: int = 1) -> DataFrame:
    """One row per record to make: ``key, clip, kind, split, variant, profile, gain_db, background``.

    Each clip gives its original, each labelled one also training views (more for
    positives) and evaluation views, which never train; each positive is mixed with seeded
    picks among ``backgrounds(number, background)``, numbered from 0.
    """
    n = F.when(F.col("label") == "positive", positives).otherwise(others)
    base = clips.select("clip", "label", F.lit("real").alias("kind"), F.lit("base").alias("split"), F.lit(0).alias("variant"), F.lit("original").alias("profile"))
    labelled = clips.where("label IN ('positive', 'negative')")
    train = labelled.withColumn("variant", F.explode(F.sequence(F.lit(1), n))).select("clip", "label", F.lit("real").alias("kind"), F.lit("train").alias("split"), "variant", F.element_at(F.array(*map(F.lit, TRAIN_PROFILES)), (F.col("variant") - 1) % len(TRAIN_PROFILES) + 1).alias("profile"))
    held = labelled.withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(len(EVALUATION_PROFILES))))).select("clip", "label", F.lit("real").alias("kind"), F.lit("evaluation").alias("split"), "variant", F.element_at(F.array(*map(F.lit, EVALUATION_PROFILES)), F.col("variant")).alias("profile"))
    mixed = clips.where("label = 'positive'").withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(mixes)))).select("clip", "label", F.lit("synthetic").alias("kind"), F.lit("train").alias("split"), "variant", F.lit("mix").alias("profile"))
    rows = base.unionByName(train).unionByName(held).unionByName(mixed)
    many = F.broadcast(backgrounds.agg(F.count(F.lit(1)).alias("_many")))
    drawn = rows.crossJoin(many).withColumn("number", F.when(F.col("kind") == "synthetic", F.pmod(hash_number(F.lit(str(seed)), F.col("clip"), F.col("variant")), F.col("_many"))))
    gain = F.when(F.col("profile") == "original", 0.0).otherwise(F.round(-12.0 + 18.0 * hash_uniform(F.lit(f"gain{seed}"), F.col("clip"), F.col("kind"), F.col("split"), F.col("variant")), 3))
    return drawn.join(backgrounds, "number", "left").select(F.concat_ws(":", "clip", "kind", "split", "variant").alias("key"), "clip", "label", "kind", "split", "variant", "profile", gain.alias("gain_db"), "background")


def shifted(intervals: F.Column, delay: F.Column, error: F.Column, codec: F.Column) -> tuple[F.Column, F.Column]:
    """Intervals moved by a delay, and their error, 5 ms more after a codec."""
    return F.transform(intervals, lambda i: F.struct((i["start_s"] + delay).alias("start_s"), (i["end_s"] + delay).alias("end_s"))), error + F.when(codec, 0.005).otherwise(0.0)


def by_priority(df: DataFrame) -> DataFrame:
    """Base, then training, then evaluation records, in their own order."""
    return df.orderBy(F.when(F.col("split") == "base", 0).when(F.col("split") == "train", 1).otherwise(2), "key")


def augmented(df: DataFrame, recipes: Sequence[tuple[str, float, float]], rate: int = 16_000, samples: str = "samples", channels: str = "channels", intervals: str = "intervals") -> DataFrame:
    """Each recording by each of a few ``recipes`` (name, gain in dB, delay in seconds): its
    other columns, ``recipe``, the samples made louder, then held within +-1, then set
    back by silence, ``delay_samples``, and the intervals moved by as much.

    ``samples`` are floats, channels interleaved; intervals are ``array<struct<start,end>>`` in
    seconds.  A recording without samples, with one that is not finite, or of other
    than one or two channels fails the job.  Values depend on the row alone.
    """
    each = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(10 ** (g / 20))).cast("float").alias("gain"), F.lit(round(d * rate)).cast("int").alias("back")) for n, g, d in recipes))
    rows = df.withColumn("_r", F.explode(each))
    own, gain, back = F.col(samples).cast("array<float>"), F.col("_r.gain"), F.col("_r.back")
    fine = F.col(channels).isin(1, 2) & (F.size(own) > 0) & F.forall(own, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")).cast("float")))
    one = F.lit(1.0).cast("float")
    louder = F.transform(own, lambda x: F.greatest(-one, F.least(one, x * gain)))
    made = F.concat(F.array_repeat(F.lit(0.0).cast("float"), back * F.col(channels)), louder)
    checked = F.when(F.coalesce(fine, F.lit(False)), made).otherwise(F.raise_error("one or two channels of finite samples").cast("array<float>"))
    moved = F.transform(intervals, lambda i: F.struct((i["start"] + back / float(rate)).alias("start"), (i["end"] + back / float(rate)).alias("end")))
    return rows.withColumns({samples: checked, intervals: moved, "recipe": F.col("_r.name"), "delay_samples": back.cast("long")}).drop("_r")
