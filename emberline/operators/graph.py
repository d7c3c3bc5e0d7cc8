"""Families: symmetric links and their transitive closure."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a private one is made only for
    a local master whose session names none."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="emberline-"))
    return named or context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """The state of an iteration, a table a round.  A checkpoint would keep the
    estimated size of its plan, which joins multiply round by round."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.number = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", 0

    def next(self, df: DataFrame) -> DataFrame:
        self.number += 1
        df.write.parquet(f"{self.path}/{self.number}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.number}")

    def last(self, df: DataFrame) -> DataFrame:
        """``df``, kept without the rounds' tables."""
        out = checkpointed(df)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return out


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def block_links(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """``src, dst``: links that connect what linking all of ``upper(node, block)`` with all
    of ``lower(node, block)`` of the same block connects, one a node instead of one a pair."""
    def to_least(of: DataFrame, other: DataFrame) -> DataFrame:
        return of.select("block", F.col("node").alias("src")).join(other.groupBy("block").agg(F.min("node").alias("dst")), "block").select("src", "dst")

    return to_least(upper, lower).union(to_least(lower, upper))


#: Nodes of a tile, of a run of one node's pairs, and named by a partition of pairs.
TILE, RUN, NAMED = 4096, 120, 8192


def block_pairs(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """``src, dst``: all pairs of ``upper(node, block)`` and ``lower(node, block)`` of the
    same block, both ways; a node lies in one block of a side, and on one side of a block.

    Pairs outgrow all else, so they come in an order that files hold in little room:
    the nodes of a block are dealt to tiles, and a row of two tiles, one for each way,
    goes to a task that names few nodes, which suit a dictionary.  There each node's
    pairs with one run of the other tile follow those of the node before, so that
    ``src`` stays and ``dst`` repeats.  Only tiles are shuffled, never pairs.
    """
    def sizes(of: DataFrame, name: str) -> DataFrame:
        return of.groupBy("block").agg(F.count(F.lit(1)).alias(f"{name}_nodes")).withColumn(f"{name}_tiles", F.ceil(F.col(f"{name}_nodes") / TILE))

    def tiles(of: DataFrame, name: str) -> DataFrame:
        tile = F.pmod(F.xxhash64("node"), F.col(f"{name}_tiles")).alias(f"{name}_tile")
        return of.join(F.broadcast(sizes(of, name)), "block").groupBy("block", tile).agg(F.collect_list("node").alias(name))

    named = sizes(upper, "u").join(sizes(lower, "l"), "block").agg(F.sum(F.expr("u_nodes * l_tiles + l_nodes * u_tiles"))).first()[0] or 1
    ways = F.array(*(F.struct(F.lit(x).alias("way"), F.col(x).alias("near"), F.col(y).alias("far")) for x, y in ("ul", "lu")))
    both = tiles(upper, "u").join(tiles(lower, "l"), "block").select("block", "u_tile", "l_tile", F.explode(ways).alias("e"))
    dealt = both.select("block", "u_tile", "l_tile", "e.*").repartitionByRange(math.ceil(named / NAMED), "block", "u_tile", "l_tile", "way")
    runs = dealt.select("near", "far", F.explode(F.sequence(F.lit(1), F.size("far"), F.lit(RUN))).alias("start")).select("near", F.slice("far", F.col("start"), RUN).alias("run"))
    # the transform keeps Spark from compiling this and the next explode into one loop, which would hold all pairs of two tiles at once
    one = runs.select(F.explode(F.transform("near", lambda x: F.struct(x.alias("src"), F.col("run").alias("run")))).alias("e")).select("e.src", "e.run")
    return one.select("src", F.explode("run").alias("dst"))


def families(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, family``: the least node that links reach, by least labels and
    pointer jumping; a table a round keeps plans short."""
    rounds_ = Rounds(edges.sparkSession)
    both = checkpointed(symmetric(edges))
    now = checkpointed(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("family")))
    for _ in range(rounds):
        near = both.join(now.select(F.col("node").alias("dst"), "family"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("family").alias("near"))
        low = now.join(near, "node").select("node", F.least("family", "near").alias("low"), F.col("family").alias("old"))
        then = rounds_.next(low.join(now.select(F.col("node").alias("low"), F.col("family").alias("up")), "low", "left").select("node", F.least("low", F.coalesce("up", "low")).alias("family"), "old"))
        settled = then.where("family <> old").limit(1).count() == 0
        now = then.select("node", "family")
        if settled:
            return rounds_.last(now)
    raise RuntimeError("families did not settle")


def reachable(start: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """All nodes that links reach from ``start(node)``, themselves included."""
    rounds_ = Rounds(edges.sparkSession)
    both = checkpointed(symmetric(edges))
    seen = front = rounds_.next(start.select("node").distinct())
    for _ in range(rounds):
        front = rounds_.next(both.join(front.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        if not front.limit(1).count():
            return rounds_.last(seen)
        seen = rounds_.next(seen.union(front))
    raise RuntimeError("the closure did not settle")
