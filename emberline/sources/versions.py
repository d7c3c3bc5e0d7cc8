"""Versioned models that go live only when they score as before, and matrices with manifests.

Both are folders of Parquet that driver and executors share.  What is written
becomes visible by one small numbered file, moved into place last; a write that
failed or gave other scores leaves the version before it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Pointer:
    """A numbered file for each version under ``path``; the greatest number counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbered(self) -> list[str]:
        at, system = self._at("current")
        return sorted(str(f.getPath().toString()) for f in system.listStatus(at)) if system.exists(at) else []

    def read(self) -> dict | None:
        found = self._numbered()
        return json.loads(self.spark.read.text(found[-1], wholetext=True).first().value) if found else None

    def move(self, content: dict) -> None:
        """Point to ``content``; fails if another writer was first."""
        number = len(self._numbered())
        fresh, system = self._at(f"fresh-{uuid.uuid4().hex}")
        out = system.create(fresh)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        at, _ = self._at(f"current/{number:08d}")
        system.mkdirs(at.getParent())
        if system.exists(at) or not system.rename(fresh, at):
            raise RuntimeError("another version was written meanwhile")


class ModelStore:
    """Models as JSON, one row each, in versions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.pointer = spark, path, Pointer(spark, path)

    def load(self, version: str | None = None) -> dict:
        """The current model, or that of a version; none is an error."""
        version = version or (self.pointer.read() or {}).get("version")
        if version is None:
            raise FileNotFoundError("the store holds no model")
        return json.loads(self.spark.read.parquet(f"{self.path}/version={version}").first().model)

    def save(self, model: dict, score: Callable[[dict, DataFrame], DataFrame], probe: DataFrame, key: str, most: float = 1e-12) -> str:
        """Write ``model`` and make it current if, read again, it scores ``probe`` as before.

        ``score(model, rows)`` gives ``key, score``.  Scores that differ by more
        than ``most``, that are missing on one side or not finite fail, and the
        version before stays current.
        """
        version = uuid.uuid4().hex
        self.spark.createDataFrame([(json.dumps(model, sort_keys=True),)], "model string").write.parquet(f"{self.path}/version={version}")
        before = score(model, probe).select(key, F.col("score").alias("a"))
        after = score(self.load(version), probe).select(key, F.col("score").alias("b"))
        far = ~(F.abs(F.col("a") - F.col("b")) <= most) | F.col("a").isNull() | F.col("b").isNull() | F.isnan("a") | F.isnan("b")
        found = before.join(after, key, "full").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(far, 1).otherwise(0)).alias("far")).first()
        if not found.n or found.far:
            raise ValueError(f"{found.far} of {found.n} scores differ after reading the model again")
        self.pointer.move({"version": version})
        return version


def row_digest(key: str, columns: Sequence[str]) -> F.Column:
    """A hash of a row's key and the bits of its values."""
    return F.xxhash64(F.col(key), *(F.col(c) for c in columns))


def _sums(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Each shard's rows, sum of hashes of rows with their places, and values that are not finite."""
    value = [F.col(c) for c in columns]
    bad = sum((F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 1).otherwise(0) for v in value), F.lit(0))
    mark = F.xxhash64(F.col("place"), row_digest(key, columns)).cast("decimal(38,0)")
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum(mark).cast("string").alias("mark"), F.sum(bad).alias("bad"))


class Matrix:
    """A matrix in shards: rows with a key, a place within their shard, and named columns of doubles."""

    def __init__(self, spark: SparkSession, path: str, key: str, columns: Sequence[str]):
        self.spark, self.path, self.key, self.columns = spark, path, key, list(columns)

    def shards(self) -> list[str]:
        """Shards that are whole: their manifest row is written after them."""
        at, system = Pointer(self.spark, self.path)._at("manifest")
        return [r.shard for r in self.spark.read.parquet(f"{self.path}/manifest").select("shard").collect()] if system.exists(at) else []

    def write(self, shard: str, rows: DataFrame) -> bool:
        """Add a shard in order of its keys, unless it is there; False if it was."""
        if shard in self.shards():
            return False
        # what a failed write of this shard left is replaced
        folder, staged = f"{self.path}/rows/shard={shard}", f"{self.path}/staged/shard={shard}"
        rows.select(self.key, *(F.col(c).cast("double").alias(c) for c in self.columns)).write.mode("overwrite").parquet(staged)
        ordered = self.spark.read.parquet(staged).orderBy(self.key)
        smaller = ordered.select(self.key).groupBy(self.key).count().where("count > 1").limit(1).count()
        if smaller:
            raise ValueError(f"shard {shard} repeats a key")
        # places along the whole order, without a window over all rows
        numbered = ordered.rdd.map(tuple).zipWithIndex().map(lambda r: (*r[0], r[1]))
        kinds = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
        schema = ", ".join([f"`{self.key}` {kinds[self.key]}", *(f"`{c}` double" for c in self.columns), "place long"])
        self.spark.createDataFrame(numbered, schema).write.mode("overwrite").parquet(folder)
        sums = _sums(self.spark.read.parquet(folder).withColumn("shard", F.lit(shard)), self.key, self.columns).withColumn("columns", F.lit(",".join([self.key, *self.columns])))
        if (sums.first() or {"bad": 0})["bad"]:
            raise ValueError(f"shard {shard} has values that are not finite")
        sums.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return True

    def read(self) -> DataFrame:
        """``shard, place, key`` and columns of all whole shards; rows, values, order or columns that
        are not those of the manifest fail."""
        manifest = self.spark.read.parquet(f"{self.path}/manifest")
        if manifest.where(F.col("columns") != ",".join([self.key, *self.columns])).limit(1).count():
            raise ValueError("the matrix has other columns")
        rows = self.spark.read.parquet(f"{self.path}/rows").withColumn("shard", F.col("shard").cast("string")).join(manifest.select("shard"), "shard", "left_semi")
        now = _sums(rows, self.key, self.columns).select("shard", F.struct("rows", "mark").alias("now"))
        wrong = manifest.select("shard", F.struct("rows", "mark").alias("then")).join(now, "shard", "full").where(~F.col("then").eqNullSafe(F.col("now")))
        if bad := wrong.select("shard").limit(10).collect():
            raise ValueError(f"shards have changed: {sorted(r.shard for r in bad)}")
        return rows.select("shard", "place", self.key, *self.columns)
