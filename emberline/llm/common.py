"""Helpers shared by the training-data operators: reading, cutting lineage, sizing."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bits of the filter that spares texts a shuffle; 1 MB at most, whatever the input.
FILTER_BITS = 23
#: Keys with more rows than this are joined by broadcast, if they are this few (some longs each).
HEAVY, FEW = 20_000, 500_000


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table, pruned to ``columns`` so that the scan reads nothing else."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a private one is made
    only for a local master whose session names none (tests)."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="emberline-checkpoint-"))
    return named or context.getCheckpointDir()


class Folder:
    """A folder of tables under the shared checkpoint folder, removed when they are no longer needed."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.count = spark, f"{checkpoint_folder(spark)}/emberline-{uuid.uuid4().hex}", 0

    def stored(self, df: DataFrame) -> DataFrame:
        """``df`` written as Parquet and read again."""
        path, self.count = f"{self.path}/{self.count}", self.count + 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread_join(rows: DataFrame, keys: DataFrame, column: str, weight: str) -> DataFrame:
    """``rows`` joined with ``keys``, which has one row of each ``column`` and is read
    twice.  Keys that ``weight`` says have many rows are sent to the rows instead,
    so that no task gets all rows of one, as long as such keys are few."""
    heavy = keys.where(F.col(weight) > HEAVY)
    if not 0 < heavy.limit(FEW + 1).count() <= FEW:
        return rows.join(keys, column)
    return rows.join(keys.where(F.col(weight) <= HEAVY), column).unionByName(rows.join(F.broadcast(heavy), column))


def among(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among ``keys``: all that are, and few
    others.  The filter has a fixed number of bits, so its size never grows."""
    return split_among(df, keys, column)[0]


def split_among(df: DataFrame, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` as :func:`among` has them, and the rest, nulls perhaps in either."""
    spot = F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS))
    # the bitmap functions count from 1
    rows = keys.select((spot + 1).alias("s")).groupBy(F.expr("bitmap_bucket_number(s)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("m")).collect()
    size = 1 << FILTER_BITS
    bits = np.zeros(size // 8, np.uint8)
    for r in rows:
        bits[(r.b - 1) * 4096 : (r.b - 1) * 4096 + len(r.m)] = np.frombuffer(bytes(r.m), np.uint8)
    held = df.sparkSession.sparkContext.broadcast(bits)

    def side(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
                ok = ((held.value[s >> 3] >> (s & 7).astype(np.uint8)) & 1 > 0) == wanted
                if ok.any():
                    yield batch.filter(pa.array(ok)).select(range(batch.num_columns - 1))

        return df.withColumn("_s", spot).mapInArrow(run, kinds)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return side(True), side(False)


def unused(columns: list[str], name: str) -> str:
    """``name``, made longer until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(total: int, each: int, least: int = 1, most: int = 65536) -> int:
    """How many pieces of about ``each`` rows hold ``total`` rows."""
    return max(least, min(most, math.ceil(total / max(each, 1))))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a record batch so that ``column`` holds about ``most_bytes`` per piece.

    A single longer value is a piece of its own, whole.
    """
    if batch.num_rows == 0:
        return
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array end to end, and the ``n + 1`` offsets of its
    values; nulls count as empty."""
    if array.null_count:
        array = pa.compute.fill_null(array, "")
    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, array.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def map_batches(df: DataFrame, column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, most_bytes: int = 2_000_000) -> DataFrame:
    """``mapInArrow`` over pieces of bounded text size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, column, most_bytes):
                out = work(piece)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def bit_likeness(a: F.Column, b: F.Column, words: int) -> F.Column:
    """Equal bits of two arrays of ``words`` longs."""
    return F.lit(64 * words) - F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
