"""A store of labels and timings, kept as numbered tables: the steps behind the command line.

Each change writes a whole table beside the last one; a table counts once its
write is complete, so a reader never meets half of one and a lost job changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators.labels import parse_intervals, review_update, valid_intervals
from emberline.sources.stores import LABELS, TIMINGS

SCHEMAS = {"labels": LABELS, "timings": TIMINGS}
#: Names that one call may give; they are compared with all rows at once.
MOST_NAMES = 1_000


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete tables of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName()) for f in found or [])


def read(spark: SparkSession, store: str, kind: str) -> DataFrame:
    versions = _versions(spark, f"{store}/{kind}")
    if not versions:
        raise FileNotFoundError(f"{store} holds no {kind}; begin with init")
    return spark.read.schema(SCHEMAS[kind]).parquet(f"{store}/{kind}/{versions[-1]}")


def put(store: str, kind: str, df: DataFrame) -> None:
    spark = df.sparkSession
    number = max(_versions(spark, f"{store}/{kind}"), default=0) + 1
    wanted = spark.createDataFrame([], SCHEMAS[kind]).schema
    df.select(*(F.col(f.name).cast(f.dataType) for f in wanted)).write.mode("errorifexists").parquet(f"{store}/{kind}/{number}")


def initialise(spark: SparkSession, store: str) -> None:
    """An empty store; one that holds tables is left as it is, with an error."""
    if any(_versions(spark, f"{store}/{kind}") for kind in SCHEMAS):
        raise FileExistsError(f"{store} holds labels or timings")
    for kind, schema in SCHEMAS.items():
        put(store, kind, spark.createDataFrame([], schema))


def overview(spark: SparkSession, store: str) -> DataFrame:
    """Positive paths with their intervals and error, null where there are none."""
    timed = read(spark, store, "timings").select("path", "intervals", "error_s")
    return read(spark, store, "labels").where("label = 'positive'").join(timed, "path", "left").orderBy("path")


def named(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The row that each of a few ``names`` is the path or file of; a name of none or of
    several fails before anything is written."""
    if len(names) > MOST_NAMES:
        raise ValueError(f"{MOST_NAMES} names at a time, at most")
    asked = df.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "_name string")
    found = df.join(F.broadcast(asked), (F.col("_name") == F.col("path")) | (F.col("_name") == F.col("file")))
    counts = {r["_name"]: r["count"] for r in found.groupBy("_name").count().collect()}
    if wrong := [n for n in names if counts.get(n) != 1]:
        raise ValueError("; ".join(f"{n} names {counts.get(n, 0)} rows" for n in wrong))
    return found.drop("_name").distinct()


def add(store: str, snapshot: DataFrame, positives: Sequence[str]) -> None:
    """Labels after a review of ``snapshot(path, file)``: those named are positive, its others
    negative unless they have a label."""
    labels = read(snapshot.sparkSession, store, "labels")
    chosen = named(snapshot, positives) if positives else snapshot.where("false")
    after = review_update(labels.select("path", "label"), snapshot.select("path").distinct(), chosen)
    put(store, "labels", after.join(labels.select("path", "note"), "path", "left"))


def time(store: str, media: DataFrame, name: str, intervals: Sequence[str], error_s: float | None = None) -> None:
    """Intervals of the positive that ``name`` is the path or file of in ``media(path, file,
    digest, duration_s)``; an error that isn't given stays what it was."""
    spark = media.sparkSession
    if error_s is not None and not 0 <= error_s < float("inf"):
        raise ValueError("an error is finite and not negative")
    before = read(spark, store, "timings")
    row = named(media, [name]).join(read(spark, store, "labels").where("label = 'positive'").select("path"), "path")
    parsed = row.select("path", "digest", "duration_s", parse_intervals(F.lit(",".join(intervals)), F.col("duration_s")).alias("intervals"))
    checked = parsed.withColumn("fine", valid_intervals(F.col("intervals"), F.col("duration_s")))
    found = checked.first()
    if found is None:
        raise ValueError(f"{name} is not positive")
    if not found.fine:
        raise ValueError(f"invalid intervals of {name}")
    kept = before.select("path", F.col("error_s").alias("_before"))
    fresh = checked.join(kept, "path", "left").select("path", F.lit("user").alias("source"), "digest", "intervals", F.coalesce(F.lit(error_s).cast("double"), "_before").alias("error_s"))
    put(store, "timings", before.join(fresh.select("path"), "path", "left_anti").select(*fresh.columns).unionByName(fresh))
