"""Reading tables, and the stand-ins of clips, windows and media among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.scalars import logistic
from emberline.operators.frames import level, number_frames, scored, trailing_baseline


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table with the named columns, so that the scan reads no others."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clip, event_id, frame, n, value, level, target``: a user's events in order
    are a clip's windows; errors are events, clicks clear of them, others unknown."""
    events = table(spark, sf_dir, "events", "user_id", "event_id", "ts", "event_type", "value").withColumnRenamed("user_id", "clip")
    numbered = number_frames(events, "clip", ["ts", "event_id"])
    return numbered.select("clip", "event_id", "frame", "n", "value", level(F.col("value")).alias("level"), F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "click", 0).otherwise(-1).alias("target"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that can be scored, with a probability that their level stands out by
    6 dB.  The probability is a stand-in for a fitted model's."""
    based = trailing_baseline(frames(spark, sf_dir)).where(scored())
    return based.withColumn("p", logistic(F.col("jump") - 6.0))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clip, label, thread``: even users are positive, every fifth other unlabelled."""
    users = table(spark, sf_dir, "events", "user_id").distinct().withColumnRenamed("user_id", "clip")
    return users.withColumn("label", F.when(F.col("clip") % 2 == 0, "positive").when(F.col("clip") % 5 == 0, "unlabeled").otherwise("negative")).withColumn("thread", F.col("clip") % 7)


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, path, file, thread, size, digest, label``: documents as media files."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels")
    file = F.concat(F.col("doc_id").cast("string"), F.lit(".mp4"))
    # sizes and digests are made before the join, so that it shuffles no texts
    named = docs.select(
        "doc_id", F.concat(F.lit("/"), "lang", F.lit("/src/"), "source", F.lit("/"), file).alias("path"), file.alias("file"), F.col("source").alias("thread"),
        F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("digest"),
    )
    label = F.when(F.col("toxic") == 1, "unlabeled").when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative").otherwise("unlabeled")
    return named.join(labels, "doc_id", "left").select(*named.columns, label.alias("label"))
