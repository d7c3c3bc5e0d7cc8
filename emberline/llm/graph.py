"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import Folder, cut


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """``node, component`` (its least node) for every node of ``edges(a, b)``.

    Each round takes the least label among a node's neighbours, then the label
    of that label, so paths shrink by more than half.  Every round is written
    to the checkpoint folder as a table (a checkpoint would keep the estimated
    size of its plan, which would be multiplied round by round); nothing is
    collected but a count of changes.
    Labels of hubs with many edges are sent to the edges, so that no task gets
    all edges of one.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    hubs = cut(both.groupBy("b").agg(F.count("*").alias("edges")).where(F.col("edges") > common.HEAVY))
    some = 0 < hubs.limit(common.FEW + 1).count() <= common.FEW
    light = both.join(F.broadcast(hubs), "b", "left_anti") if some else both

    def neighbours(labels: DataFrame) -> DataFrame:
        to = labels.select(F.col("node").alias("b"), "component")
        if not some:
            return both.join(to, "b").select("a", "component")
        return light.join(to, "b").select("a", "component").union(both.join(F.broadcast(to.join(hubs, "b", "left_semi")), "b").select("a", "component"))

    folder = Folder(edges.sparkSession)
    for _ in range(rounds):
        near = neighbours(labels).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("component", "near").alias("low"), F.col("component").alias("old"))
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("up"))
        after = folder.stored(lower.join(up, "low", "left").select("node", F.least("low", F.coalesce("up", "low")).alias("component"), "old"))
        changed = after.where("component <> old").limit(1).count()
        labels = after.select("node", "component")
        if not changed:
            labels = cut(labels)
            folder.remove()
            return labels
    raise RuntimeError("components did not settle")
