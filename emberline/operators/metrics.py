"""Detection, ranking and paired-change metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.scalars import ALERT, MAYBE, hash_number, tier_rank

from .graph import checkpointed
from .tables import numbered

#: Clusters that are sent to the draws, seven numbers each; more are joined by a shuffle.
FEW_CLUSTERS = 500_000
#: Picks that one task makes.
PICKS = 10_000_000


def _count(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def detection_metrics(df: DataFrame, groups: list[str] | None = None, label: str = "label", score: str = "score", sets: bool = False) -> DataFrame:
    """Counts at both tiers in one pass; unknown labels take no part.  With ``sets``
    the total (null group) comes along by grouping sets."""
    pos, neg, s = F.col(label) == "positive", F.col(label) == "negative", F.col(score)
    known = df.where(F.col(label).isin("positive", "negative"))
    grouped = known.rollup(*groups) if sets else known.groupBy(*(groups or []))
    out = grouped.agg(
        _count(pos).alias("positives"), _count(neg).alias("negatives"),
        _count(pos & (s >= ALERT)).alias("detected_alert"), _count(pos & (s < ALERT)).alias("missed_alert"), _count(neg & (s >= ALERT)).alias("false_alert"),
        _count(pos & (s >= MAYBE)).alias("detected_maybe"), _count(neg & (s >= MAYBE)).alias("false_maybe"), _count(neg & (s >= MAYBE) & (s < ALERT)).alias("yellow_only"),
    )
    per = lambda c: F.when(F.col("negatives") > 0, F.round(1000.0 * F.col(c) / F.col("negatives"), 6))
    return out.withColumn("false_alert_per_1000", per("false_alert")).withColumn("false_maybe_per_1000", per("false_maybe"))


def by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives at each distinct score, with running sums from the
    top.  Scores are added up first, so the running sums go over distinct values,
    each range of them in a task of its own."""
    counts = df.groupBy(F.col(score).alias("s")).agg(_count(F.col(label)).alias("tp"), _count(~F.col(label)).alias("fp"))
    # score ranges are summed by themselves; what lies above each comes from one row a range
    ranged = checkpointed(counts.repartitionByRange(F.col("s").desc()).withColumn("_range", F.spark_partition_id()))
    above = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_range").agg(F.sum("tp").alias("_tp"), F.sum("fp").alias("_fp"))
    before = sums.select("_range", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("_tp", "_fp")))
    w = Window.partitionBy("_range").orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    held = ranged.join(F.broadcast(before), "_range")
    return held.select("s", "tp", "fp", (F.sum("tp").over(w) + F.col("_tp_above")).alias("cum_tp"), (F.sum("fp").over(w) + F.col("_fp_above")).alias("cum_fp"))


def average_precision(df: DataFrame, label: str = "positive", score: str = "score") -> DataFrame:
    """Step-wise area under precision over recall, tied scores at once; null
    without positives."""
    runs = by_score(df, label, score)
    return runs.agg((F.sum(F.col("tp") * F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))) / F.nullif(F.sum("tp"), F.lit(0))).alias("average_precision"))


def roc_auc(df: DataFrame, label: str = "positive", score: str = "score") -> DataFrame:
    """Share of positive-negative pairs in order, ties half; null without both."""
    runs = by_score(df, label, score)
    return runs.agg((F.sum(F.col("fp") * (F.col("cum_tp") - F.col("tp") / 2.0)) / F.nullif(F.sum("tp") * F.sum("fp"), F.lit(0))).alias("roc_auc"))


def tier_confusion(df: DataFrame, label: str = "label", tier: str = "tier") -> DataFrame:
    return df.groupBy(label, tier).agg(F.count(F.lit(1)).alias("clips"))


def paired_change(df: DataFrame, before: str = "before", after: str = "after", groups: tuple[str, ...] = ()) -> DataFrame:
    """Changes between two scores of the same clip."""
    d = F.abs(F.col(after) - F.col(before))
    a, b = tier_rank(F.col(before)), tier_rank(F.col(after))
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("clips"), F.percentile(d, F.lit(0.5)).alias("median_change"), F.percentile(d, F.lit(0.95)).alias("p95_change"), F.max(d).alias("max_change"),
        _count(a != b).alias("tier_changes"), _count((a == 2) & (b < 2)).alias("red_lower"), _count((a >= 1) & (b == 0)).alias("warning_low"), _count((a == 0) & (b >= 1)).alias("low_warning"),
    )


def worst_view(df: DataFrame, clip: str = "clip", label: str = "label", score: str = "score") -> DataFrame:
    """Over a clip's views: a positive's least score, any other's greatest."""
    return df.groupBy(clip, label).agg(F.min(score).alias("_low"), F.max(score).alias("_high")).select(clip, label, F.when(F.col(label) == "positive", F.col("_low")).otherwise(F.col("_high")).alias("score"))


def cluster_bootstrap(df: DataFrame, cluster: str, draws: int = 10_000, seed: int = 1, label: str = "label", before: str = "before", after: str = "after") -> DataFrame:
    """Percentile interval of the changes in recall and false alerts per 1000 when
    whole clusters are drawn with replacement.

    Counts are added up by cluster first; a draw picks as many clusters as
    there are, by hashes of seed, draw and place, so reruns agree.  Picks are made
    in even tasks, whatever the number of draws, and add up by draw before they are shuffled.
    """
    pos, neg = F.col(label) == "positive", F.col(label) == "negative"
    hit = lambda c: (F.col(c) >= ALERT)
    each = df.groupBy(cluster).agg(_count(pos).alias("p"), _count(neg).alias("n"), *(_count(w & hit(c)).alias(x) for x, w, c in (("pb", pos, before), ("pa", pos, after), ("nb", neg, before), ("na", neg, after))))
    clusters = numbered(each, cluster)
    many, spark = clusters.count(), df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-draws * many // PICKS))
    picks = spark.range(0, draws * many, 1, tasks).select(F.floor(F.col("id") / max(many, 1)).alias("draw"), (F.col("id") % max(many, 1)).alias("place"))
    picks = picks.select("draw", F.pmod(hash_number(F.lit(str(seed)), F.col("draw"), F.col("place")), F.lit(max(many, 1))).alias("number"))
    held = F.broadcast(clusters) if many <= FEW_CLUSTERS else clusters
    sums = picks.join(held, "number").groupBy("draw").agg(*(F.sum(c).alias(c) for c in ("p", "n", "pb", "pa", "nb", "na"))).where((F.col("p") > 0) & (F.col("n") > 0))
    deltas = sums.select(((F.col("pa") - F.col("pb")) / F.col("p")).alias("recall"), (1000.0 * (F.col("na") - F.col("nb")) / F.col("n")).alias("false"))
    return deltas.agg(F.count(F.lit(1)).alias("draws"), *(F.percentile(c, F.lit(q)).alias(f"{c}_{name}") for c in ("recall", "false") for q, name in ((0.025, "low"), (0.975, "high"))))
