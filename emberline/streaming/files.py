"""Structured Streaming forms: landed files to completion, tumbling levels with
late data, and duplicate suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def landed(spark: SparkSession, folder: str, schema: StructType, per_trigger: int = 6, clean: bool = False) -> DataFrame:
    """Files of a folder as they land, a bounded number at once; consumed ones may
    be deleted."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    if clean:
        reader = reader.option("cleanSource", "delete")
    return reader.parquet(folder)


def window_levels(stream: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events, mean power and peak of each type and event-time window, within the
    lateness allowed."""
    return (
        stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
        .groupBy(F.window("at", size).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("events"), F.avg(F.col("value") * F.col("value")).alias("power"), F.max("value").alias("peak"))
        .select(F.col("w.start").alias("start"), "event_type", "events", "power", "peak")
    )


def without_repeats(stream: DataFrame, key: str, late: str = "2 hours") -> DataFrame:
    """The first row of each key within the lateness; later ones are in flight or done."""
    return stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def current_generation(stream: DataFrame, generation: int) -> DataFrame:
    """Results of the present generation; what a reset left behind is stale."""
    return stream.where(F.col("generation") == generation)


def drain(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run to completion on what has landed, into Parquet with exactly-once files."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(folder)


def drain_totals(stream: DataFrame, key: list[str], totals: dict[str, F.Column], folder: str, checkpoint: str) -> DataFrame:
    """Running totals by key to completion: each batch's partial sums are written
    once by batch number, and added up when read."""
    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*key).agg(*(c.alias(n) for n, c in totals.items())).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(folder).drop("batch").groupBy(*key).agg(*(F.sum(n).alias(n) for n in totals))
