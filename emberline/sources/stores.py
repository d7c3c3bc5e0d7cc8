"""Label and timing stores, threads by mirror, WAV files, models and lineage."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = "path string, label string, note string"
TIMINGS = "path string, source string, digest string, intervals array<struct<start_s:double,end_s:double>>, error_s double"


def read_or_empty(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A store, or an empty one with its schema where there is none yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).format(kind).load(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def timing_faults(timings: DataFrame, labels: DataFrame, durations: DataFrame) -> DataFrame:
    """``path, fault`` of timings that are not a confirmed positive's, not a user's,
    of invalid intervals or error, or made for other bytes."""
    from emberline.operators.labels import valid_intervals

    positive = labels.where("label = 'positive'").select("path", F.lit(True).alias("_positive"))
    held = timings.join(positive, "path", "left").join(durations.select("path", "duration_s", F.col("digest").alias("_digest")), "path", "left")
    fault = (
        F.when(F.col("_positive").isNull(), "not positive").when(F.col("source") != "user", "not a user's")
        .when(~F.coalesce(valid_intervals(F.col("intervals"), F.col("duration_s")), F.lit(False)), "invalid intervals")
        .when(~F.coalesce((F.col("error_s") >= 0) & (F.col("error_s") < float("inf")), F.lit(True)), "invalid error").when(F.col("digest") != F.col("_digest"), "stale")
    )
    return held.select("path", fault.alias("fault")).where(F.col("fault").isNotNull())


def fetch(url: str, mirrors: Iterable[str], get: Callable[[str], bytes]) -> bytes:
    """The first answer from the host asked for and then the mirrors, each tried
    once; if all fail, an error that lists each."""
    from urllib.parse import urlsplit, urlunsplit

    parts = urlsplit(url)
    errors = []
    for host in dict.fromkeys([parts.netloc, *mirrors]):
        try:
            return get(urlunsplit(parts._replace(netloc=host)))
        except OSError as error:
            errors.append(f"{host}: {error}")
    raise OSError("; ".join(errors))


def wav_frames(spark: SparkSession, folder: str, size: int = 160) -> DataFrame:
    """``path, channel, frame, power, peak`` of WAV files; unreadable ones have null
    figures and an ``error``, never a guess."""
    import numpy as np
    import pandas as pd

    from emberline.operators.signal import read_wav

    def run(batches):
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    x = read_wav(raw)
                except ValueError as error:
                    yield pd.DataFrame({"path": [path], "channel": [None], "frame": [None], "power": [None], "peak": [None], "error": [str(error)[-1000:]]})
                    continue
                n = x.shape[1] // size
                f = x[:, : n * size].reshape(len(x), n, size).astype(float)
                yield pd.DataFrame({"path": path, "channel": np.repeat(np.arange(len(x)), n), "frame": np.tile(np.arange(n), len(x)), "power": (f**2).mean(axis=2).ravel(), "peak": np.abs(f).max(axis=2).ravel(), "error": None})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder).select("path", "content")
    return files.mapInPandas(run, "path string, channel int, frame int, power double, peak double, error string")


def write_table(df: DataFrame, path: str, lead: list[str], kind: str = "csv") -> None:
    """Leading columns, then the others by name; CSV with a header, or JSON lines."""
    out = df.select(*lead, *sorted(c for c in df.columns if c not in lead))
    out.write.mode("errorifexists").option("header", True).format(kind).save(path)


def checked(df: DataFrame, columns: list[str]) -> DataFrame:
    """Raises on a value that is NaN or infinite; missing is null."""
    bad = F.array_max(F.array(*(F.coalesce(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(False)) for c in columns)))
    return df.where(F.assert_true(~bad, F.lit("a value is not finite")).isNull())


def fingerprint(value: object) -> str:
    """SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def lineage(stage: str, inputs: dict[str, str], settings: dict) -> dict:
    """What a stage was made from; equal inputs and settings have one key."""
    return {"stage": stage, "inputs": inputs, "settings": settings, "key": fingerprint([stage, inputs, settings])[:16]}


def assert_fresh(made: dict, inputs: dict[str, str]) -> None:
    """A stage's inputs must still be what it was made from."""
    if stale := sorted(k for k in {*made["inputs"], *inputs} if made["inputs"].get(k) != inputs.get(k)):
        raise ValueError(f"stale inputs of {made['stage']}: {', '.join(stale)}")


def publish_model(spark: SparkSession, path: str, model: dict) -> None:
    """A model as one JSON row with its hash."""
    body = json.dumps(model, sort_keys=True)
    spark.createDataFrame([(body, hashlib.sha256(body.encode()).hexdigest())], "body string, sha256 string").coalesce(1).write.mode("errorifexists").json(path)


def load_model(spark: SparkSession, path: str) -> dict:
    row = spark.read.schema("body string, sha256 string").json(path).first()
    if hashlib.sha256(row.body.encode()).hexdigest() != row.sha256:
        raise ValueError("the model's hash does not match")
    return json.loads(row.body)
