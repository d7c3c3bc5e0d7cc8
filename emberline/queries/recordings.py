"""Queries of feature tables: events' levels, bursts, rhythm, bands, roughness, context.

A clip's levels stand in 40 dB lower for a recording's, its frames for 10 ms rows and
every fifth of them for 50 ms rows; embeddings repeated stand in for samples.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.scalars import amplitude_db, hash_number, norm
from emberline.operators import extract, synthesis
from emberline.operators import features as E
from emberline.operators import vectors
from emberline.sources.tables import frames, table

from .common import Registry
from .timeline import points

query = Registry()
QUERIES, SQL = query.queries, query.sql


def rounded(df: DataFrame, names: tuple[str, ...], key: str = "clip") -> DataFrame:
    return df.select(key, *(F.round(n, 6).alias(n) for n in names))


def pointed(spark: SparkSession, sf: str) -> DataFrame:
    """``clip, frame, level, value, point``, the point being the frame of the greatest jump."""
    return frames(spark, sf).select("clip", "frame", (F.col("level") - 40.0).alias("level"), "value").join(points(spark, sf), "clip")


def spectra(values: np.ndarray) -> np.ndarray:
    """A made spectrum for each value."""
    raw = 1.0 + np.floor(values)[:, None] * np.arange(1, E.BINS + 1)[None, :] % 97
    return raw / raw.sum(axis=1, keepdims=True)


def column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


@query()
def burst_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.per_clip(pointed(spark, sf), E.BURST, lambda t: E.burst(column(t, "level"), t["point"][0].as_py())), E.BURST)


@query()
def rhythm_features(spark: SparkSession, sf: str) -> DataFrame:
    def kernel(t: pa.Table) -> dict[str, float]:
        point = t["point"][0].as_py()
        return E.rhythm(column(t, "level"), point, spectra(column(t, "value")[::5]), point // 5)

    return rounded(E.per_clip(pointed(spark, sf), E.RHYTHM, kernel), E.RHYTHM)


@query()
def event_features(spark: SparkSession, sf: str) -> DataFrame:
    """Frames stand in for 50 ms rows, five equal ones of 10 ms each."""

    def kernel(t: pa.Table) -> dict[str, float]:
        level, value, row = column(t, "level"), column(t, "value"), t["point"][0].as_py()
        before = E.between(level, row - 60, row - 2)
        baseline = E.quantile(before, 50)
        chosen = E.quantile(E.between(level, row, row + 6), 25), baseline, E.quantile(np.abs(before - baseline), 50)
        return E.event(level, np.repeat(level, 5), (value >= 445.0).astype(float), spectra(value), row, *chosen)

    return rounded(E.per_clip(pointed(spark, sf), E.EVENT, kernel), E.EVENT)


def _samples(embedding: np.ndarray) -> np.ndarray:
    """1.6 s of a vector's entries over and over, louder in the last 0.6 s."""
    x = np.resize(embedding.astype(float), 25_600)
    x[16_000:] *= 8
    return x[:, None]


def recording(spark: SparkSession, sf: str, kernel, names: tuple[str, ...]) -> DataFrame:
    work = lambda batches: E.recordings(batches, lambda x: kernel(_samples(x), 1.0), names, "vec_id", "embedding")
    df = table(spark, sf, "embeddings", "vec_id", "embedding")
    return rounded(df.mapInArrow(work, ", ".join(["vec_id long", *(f"`{n}` double" for n in names)])), names, "vec_id")


@query()
def band_features(spark: SparkSession, sf: str) -> DataFrame:
    return recording(spark, sf, E.bands, E.BANDS)


@query()
def roughness_features(spark: SparkSession, sf: str) -> DataFrame:
    return recording(spark, sf, E.roughness, E.ROUGHNESS)


#: A made head: scores of eight categories from the first entries of a vector.
HEAD = [[round(((7 * i + 3 * j) % 11 - 5) / 5, 1) for j in range(6)] for i in range(8)]
GROUPS = {"speech": [0], "music": [1], "vocal_alarm": [2, 3], "singing": [4], "laughter": [5], "noise": [6, 7], "silence": [0, 7]}


@query()
def context_features(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with the ones before and after them by number as their surroundings."""
    df = table(spark, sf, "embeddings", "vec_id", "embedding").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("event"))
    beside = lambda k, name: df.select((F.col("vec_id") - k).alias("vec_id"), F.col("event").alias(name))
    three = df.join(beside(-1, "before"), "vec_id").join(beside(1, "after"), "vec_id").withColumn("position_s", F.col("vec_id") * 0.05)
    out = vectors.context_features(three, HEAD, [0.0] * 8, GROUPS)
    return rounded(out, tuple(c for c in out.columns if c.startswith("ctx_")), "vec_id")


def sounds(spark: SparkSession, sf: str) -> DataFrame:
    """``recording, part, samples``: the bytes of 500 documents' texts of one source, in order, stand in for a recording of 8 bits a sample."""
    name = F.concat_ws("/", F.coalesce("source", F.lit("")), F.floor(F.col("doc_id") / 500).cast("string"))
    return table(spark, sf, "documents", "doc_id", "text", "source").select(name.alias("recording"), F.col("doc_id").alias("part"), F.encode("text", "UTF-8").alias("samples"))


def six(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(f.name, 6).alias(f.name) if f.dataType.simpleString() == "double" else f.name for f in df.schema.fields))


@query()
def robust_features(spark: SparkSession, sf: str) -> DataFrame:
    return six(extract.robust_features(sounds(spark, sf), "recording", "part"))


@query()
def short_features(spark: SparkSession, sf: str) -> DataFrame:
    return six(extract.short_features(sounds(spark, sf), "recording", "part"))


@query()
def clip_features(spark: SparkSession, sf: str) -> DataFrame:
    return six(extract.clip_features(sounds(spark, sf), "recording", "part"))


#: A made model: mean, scale and weight of some features; its intercept and the power of its pooling.
MODEL, INTERCEPT, POWER = {"jump_db": (1.0, 3.0, 1.5), "burst_peak_jump_db": (4.0, 4.0, 0.8), "duration_s": (0.5, 1.0, 0.5), "rhythm_onset_periodicity": (0.4, 0.2, -0.7)}, -0.5, 4.0


@query()
def robust_detector(spark: SparkSession, sf: str) -> DataFrame:
    """Recordings scored by their proposed points: silence rule, pooled score, tier, the five likeliest windows."""
    out = extract.detector(extract.robust_features(sounds(spark, sf), "recording", "part"), MODEL, INTERCEPT, POWER, "recording")
    events = F.transform("events", lambda e: F.struct(F.round(e["start_s"], 6).alias("start_s"), F.round(e["end_s"], 6).alias("end_s"), F.round(e["score"], 6).alias("score")))
    return out.select("recording", F.round("score", 6).alias("score"), "risk_tier", "silent", "analyzed_events", F.to_json(events).alias("events"))


#: Samples a second at which twelve seconds fit into the stand-in recordings.
_RATE = 2_000
#: Donors are every third recording, with two intervals; the others are backgrounds.
_SOUNDS = """sounds AS (SELECT coalesce(source, '') || '/' || (doc_id // 500) AS recording, sum(coalesce(octet_length(encode(text)), 0))::BIGINT AS samples FROM documents GROUP BY 1),
  roles AS (SELECT *, ('0x' || substr(md5('role:' || recording), 1, 8))::BIGINT % 3 = 0 AS donor FROM sounds)"""


def _hashed(what: str) -> str:
    return f"('0x' || substr(md5('{what}1:' || donor || ':' || variant), 1, 8))::BIGINT"


def synthesis_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    samples = sounds(spark, sf).groupBy("recording").agg(F.sum(F.coalesce(F.octet_length("samples"), F.lit(0))).cast("long").alias("samples"))
    gives = hash_number(F.lit("role"), F.col("recording")) % 3 == 0
    span = lambda a, b: F.struct((F.col("samples") / _RATE * a).alias("start_s"), (F.col("samples") / _RATE * b).alias("end_s"))
    donors = samples.where(gives & (F.col("samples") >= 2 * _RATE)).select(F.col("recording").alias("donor"), F.array(span(0.125, 0.375), span(0.5, 0.875)).alias("intervals"), F.lit(None).cast("double").alias("error_s"))
    return donors, samples.where(~gives).select(F.col("recording").alias("background"), "samples")


@query(f"""WITH {_SOUNDS}, back AS (SELECT recording AS background, samples, row_number() OVER (ORDER BY recording) - 1 AS number FROM roles WHERE NOT donor AND samples >= {12 * _RATE}), many AS (SELECT count(*) AS many FROM back),
  given AS (SELECT recording AS donor, v AS variant, samples / {_RATE}.0::DOUBLE AS s FROM roles, range(0, 12) g(v) WHERE donor AND samples >= {2 * _RATE}),
  spans AS (SELECT *, s * CASE WHEN variant % 2 = 0 THEN 0.125::DOUBLE ELSE 0.5::DOUBLE END + 0.05::DOUBLE AS low, s * CASE WHEN variant % 2 = 0 THEN 0.375::DOUBLE ELSE 0.875::DOUBLE END - 0.05::DOUBLE AS high FROM given),
  lasting AS (SELECT *, least([0.35::DOUBLE, 0.75::DOUBLE, 1.5::DOUBLE][variant % 3 + 1], high - low) AS d FROM spans),
  placed AS (SELECT *, low + {_hashed('source')} / 4294967296.0::DOUBLE * greatest(0.0::DOUBLE, high - d - low) AS begins FROM lasting)
  SELECT donor || ':' || variant AS key, background, {_hashed('offset')} % greatest(1, samples - {12 * _RATE}) AS background_first, round_even(begins * {_RATE}, 0)::BIGINT AS source_first,
    round_even((begins + d) * {_RATE}, 0)::BIGINT - round_even(begins * {_RATE}, 0)::BIGINT AS source_samples, round(3.0::DOUBLE + 5.0::DOUBLE * ({_hashed('onset')} / 4294967296.0::DOUBLE), 6) AS onset_s,
    [-12.0::DOUBLE, -6.0::DOUBLE, -3.0::DOUBLE][variant % 3 + 1] AS level_db, [10.0::DOUBLE, 20.0::DOUBLE, 30.0::DOUBLE][variant // 3 % 3 + 1] AS contrast_db
  FROM placed, many JOIN back ON number = {_hashed('background')} % many""")
def synthetic_plan(spark: SparkSession, sf: str) -> DataFrame:
    plan = synthesis.synthetic_plan(*synthesis_sides(spark, sf), rate=_RATE)
    return plan.select("key", "background", "background_first", "source_first", "source_samples", F.round("onset_s", 6).alias("onset_s"), "level_db", "contrast_db")


@query()
def synthetic_events(spark: SparkSession, sf: str) -> DataFrame:
    """Every planned record and its control: parents, interval, digest and level of its event."""
    chunks = sounds(spark, sf).withColumnsRenamed({"samples": "sound"})
    made = synthesis.synthetic_events(synthesis.synthetic_plan(*synthesis_sides(spark, sf), rate=_RATE), chunks, _RATE)
    event = F.slice("samples", (F.bround(F.col("onset_s") * _RATE) + 1).cast("int"), F.bround((F.col("end_s") - F.col("onset_s")) * _RATE).cast("int"))
    level = amplitude_db(norm(event) / F.sqrt(F.size(event)))
    return made.select("key", "label", "donor", "background", F.round("onset_s", 6).alias("onset_s"), F.round("end_s", 6).alias("end_s"), F.size("samples").alias("samples"), "digest", F.round(level, 3).alias("event_db"))
