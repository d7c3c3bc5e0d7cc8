"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source has the same expected number of copies, its source's
target over its source's size.  With the documents of a source in order of
size, the prefix sum of expected copies plus one random offset per source is
cut at each integer, and a document is taken once per integer crossed.  As
neighbours in that order are alike in size, the words taken come near the
target, and no document is taken more often than the rate rounded up.

The place of a document within its source comes from one range shuffle of
``(source, size, id)`` over all rows, and the offsets of the partitions' pieces
are added up from one small row per partition and source; a source that holds
a third of all rows therefore spreads over as many tasks as any other rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """One row per source: ``source, source_size, target``.

    ``weights`` repeat over the sources by code point, null last.  The sum of
    all sizes is shared by weight; a share stops at ``most`` times its source's
    size and what it leaves goes to the others by weight, until none is above.
    Sources by ascending ``most * size / weight`` stop one after the other, so
    the level at which the others rest follows from running sums over the
    sources, of which there is one row each.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((place - 1) % len(weights) + 1).cast("int"))
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    return (
        totals.withColumn("weight", weight)
        .withColumn("level", most * F.col("source_size") / F.col("weight"))
        .withColumn("rest", F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("rests", F.col("rest") / F.col("rest_weight"))
        # the first source that does not stop sets the level of all that follow
        .withColumn("at", F.min(F.when(F.col("level") >= F.col("rests"), F.struct("level", "rests"))).over(everything)["rests"])
        .select("source", "source_size", F.least(most * F.col("source_size"), F.coalesce(F.col("at"), F.lit(float("inf"))) * F.col("weight")).alias("target"))
    )


def source_offset(source: F.Column, seed: int) -> F.Column:
    """A uniform offset in (0, 1) that depends on the source's name and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 7), 16, 10).cast("double") + 0.5) / float(1 << 28)


def mix_sources(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 1) -> DataFrame:
    """``key, size, source, source_size, target, copies, taken`` for every row.

    Null and empty texts have size 0 and take nothing.  Null is a source of its
    own, the last one.  Repeated rows and ties each have their own place.  A
    source of size 0 has target 0.  An empty table gives an empty result.
    Other columns play no part, whatever their names.
    """
    sizes = cut(df.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    targets = source_targets(sizes, weights, most)
    # one global order; the row's place is its number in its partition after the pieces before it
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("key")]
    ranged = cut(sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftright("id", 33)
    first = (
        ranged.groupBy(part.alias("part"), "source").agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n"))
        .join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select("part", F.col("source").alias("s"), "first", "before", "source_size", "target")
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.col("id") - F.col("first") + F.col("before")
    offset = source_offset(F.col("source"), seed)
    upto = lambda k: F.floor(k * F.col("rate") + F.col("offset"))
    return (
        ranged.withColumn("part", part)
        .join(first.withColumnRenamed("part", "p"), (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
        .withColumn("rate", rate)
        .withColumn("offset", offset)
        .withColumn("copies", upto(place + 1) - upto(place))
        .select(F.col("key").alias(key), "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def emit_copies(mixed: DataFrame) -> DataFrame:
    """One row per copy taken, with its number from 0."""
    return mixed.where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
