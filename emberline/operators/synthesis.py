"""Synthetic training records: part of a donor's event laid over a background.

A plan says, by hashes of its own keys alone, which samples each record takes.
Only these samples are cut out of the recordings' chunks and shuffled; a record
is at most twelve seconds long, whatever the recordings are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.scalars import hash_number, hash_uniform

from .graph import checkpointed
from .signal import RATE
from .tables import numbered

# Variants of a donor, seconds of events, their levels, how far the background lies below, seconds of background, bounds of the onset.
VARIANTS, SECONDS, LEVELS_DB, CONTRASTS_DB = 12, (0.35, 0.75, 1.5), (-12.0, -6.0, -3.0), (10.0, 20.0, 30.0)
BACKGROUND_S, ONSET_S = 12, (3.0, 8.0)
# Greatest sample, seconds of fading, margin of an event without a stated one.
PEAK, FADE_S, ERROR_S = 0.98, 0.005, 0.05


def _picked(values: tuple[float, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def synthetic_plan(donors: DataFrame, backgrounds: DataFrame, seed: int = 1, variants: int = VARIANTS, rate: int = RATE) -> DataFrame:
    """What each record is made of: ``key, donor, variant, background, background_first,
    source_s, source_first, source_samples, onset_s, level_db, contrast_db``.

    ``donors(donor, intervals, error_s)`` have intervals ``array<struct<start_s,end_s>>`` in
    seconds, taken by turns, each side's error left out; ``backgrounds(background, samples)``
    shorter than 12 s are not drawn.  A null error is 50 ms.  A donor without
    intervals, or with one inside its errors, and a lack of backgrounds fail the job.
    """
    long = numbered(backgrounds.where(F.col("samples") >= BACKGROUND_S * rate), "background")
    many = long.agg(F.count(F.lit(1)).alias("_many"))
    each = donors.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1)))).crossJoin(F.broadcast(many))
    v, named = F.col("variant"), lambda what: (F.lit(f"{what}{seed}"), F.col("donor"), F.col("variant"))
    drawn = F.when(F.col("_many") > 0, F.col("background")).otherwise(F.raise_error(f"no background of {BACKGROUND_S} s").cast(long.schema["background"].dataType))
    stated = F.when(F.size("intervals") > 0, F.col("intervals")).otherwise(F.raise_error(F.concat(F.lit("no interval of "), F.col("donor").cast("string"))))
    own = F.element_at(stated, (v % F.size("intervals") + 1).cast("int"))
    error = F.coalesce(F.col("error_s"), F.lit(ERROR_S))
    each = each.withColumn("number", F.pmod(hash_number(*named("background")), F.nullif(F.col("_many"), F.lit(0)))).withColumn("_low", own["start_s"] + error).withColumn("_high", own["end_s"] - error)
    each = each.withColumn("_s", F.least(_picked(SECONDS, v), F.col("_high") - F.col("_low")))
    each = each.withColumn("source_s", F.col("_low") + hash_uniform(*named("source")) * F.greatest(F.lit(0.0), F.col("_high") - F.col("_s") - F.col("_low")))
    first = F.bround(F.col("source_s") * rate).cast("long")
    length = F.bround((F.col("source_s") + F.col("_s")) * rate).cast("long") - first
    fits = F.when(length >= 2, length).otherwise(F.raise_error(F.concat(F.lit("an interval within its errors: "), F.col("donor").cast("string"))).cast("long"))
    space = F.greatest(F.lit(1), F.col("samples") - BACKGROUND_S * rate)
    return each.join(long, "number", "left").select(
        F.concat_ws(":", "donor", "variant").alias("key"), "donor", "variant", drawn.alias("background"), F.pmod(hash_number(*named("offset")), space).alias("background_first"),
        "source_s", first.alias("source_first"), fits.alias("source_samples"), (ONSET_S[0] + (ONSET_S[1] - ONSET_S[0]) * hash_uniform(*named("onset"))).alias("onset_s"),
        _picked(LEVELS_DB, v).alias("level_db"), _picked(CONTRASTS_DB, F.floor(v / len(SECONDS))).alias("contrast_db"),
    )


def cut_out(wanted: DataFrame, chunks: DataFrame, width: int = 1) -> DataFrame:
    """``wanted(id, recording, first, samples)`` with their ``sound``, the bytes of these samples
    of ``width`` bytes each, from ``chunks(recording, part, sound)`` in order of part.

    Chunks meet only the rows whose samples they hold; what isn't there is left out.
    """
    sizes = chunks.select("recording", "part", F.octet_length("sound").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("recording").orderBy("part"))
    placed = sizes.select("recording", "part", (upto - F.col("_n")).alias("_from"), upto.alias("_to"))
    w = wanted.select("id", "recording", (F.col("first") * width).alias("_a"), ((F.col("first") + F.col("samples")) * width).alias("_b"))
    # rows and chunks are matched before any sound is read
    hits = placed.join(w, (placed.recording == w.recording) & (F.col("_from") < F.col("_b")) & (F.col("_to") > F.col("_a"))).select(placed.recording, "part", "id", "_from", "_a", "_b")
    skipped = F.greatest(F.lit(0), F.col("_a") - F.col("_from"))
    piece = F.expr("substring(sound, cast(_skip + 1 as int), cast(_b - _from - _skip as int))")
    cut = hits.join(chunks, ["recording", "part"]).withColumn("_skip", skipped).select("id", F.struct("_from", piece.alias("sound")).alias("p"))
    whole = cut.groupBy("id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return wanted.join(whole.select("id", F.aggregate("ps", F.lit(b""), lambda a, p: F.concat(a, p["sound"])).alias("sound")), "id", "left")


def faded(length: int, rate: int = RATE) -> np.ndarray:
    """Weights of an event that sets in and ends over 5 ms, half its length at most."""
    steps = min(round(FADE_S * rate), length // 2)
    edge = np.minimum(np.arange(length), np.arange(length)[::-1])
    return np.clip(edge / max(steps - 1, 1), 0.0, 1.0) if steps > 1 else (edge >= steps).astype(float)


def overlaid(background: np.ndarray, event: np.ndarray, first: int, level_db: float, contrast_db: float, rate: int = RATE) -> tuple[np.ndarray, np.ndarray]:
    """The record with the event from sample ``first`` on, and its control, which goes through the
    same fade without it.

    The event has ``level_db`` in the mean square, the background ``contrast_db`` less than the
    event then has, each only as far as no sample exceeds :data:`PEAK`.
    """
    def scaled(x: np.ndarray, wanted: float, least: float) -> np.ndarray:
        top = float(np.abs(x).max())
        return x * min(wanted / max(float(np.sqrt(np.mean(x * x))), 1e-9), PEAK / max(top, least))

    if not len(event) or first < 0 or first + len(event) > len(background):
        raise ValueError("the event doesn't fit into its background")
    if not np.abs(event).max() > 0:
        raise ValueError("a silent event")
    sound = scaled(event.astype(float), 10 ** (level_db / 20), 0.0)
    below = scaled(background.astype(float), float(np.sqrt(np.mean(sound * sound))) / 10 ** (contrast_db / 20), 1e-9)
    weight, novel = np.zeros(len(below)), np.zeros(len(below))
    weight[first : first + len(event)] = faded(len(event), rate)
    novel[first : first + len(event)] = sound
    return tuple((below * (1 - weight) + over * weight).astype(np.float32) for over in (novel, below))


RECORD = "key string, label string, onset_s double, end_s double, digest string, samples array<float>"


def synthetic_events(plan: DataFrame, chunks: DataFrame, rate: int = RATE) -> DataFrame:
    """Two records for each row of ``plan``, positive and its control (negative), with
    ``parents`` (donor, background), for :func:`emberline.operators.folds` to keep
    in training only: ``key, label, onset_s, end_s, digest, samples, donor, background``.

    ``chunks(recording, part, sound)`` hold unsigned 8-bit samples.  Null and empty sounds are
    as if absent.  Too few samples, a silent event or null part of a plan fail the job; an
    empty plan gives no rows, repeated keys their records again.
    """
    rows = checkpointed(plan.withColumn("id", F.monotonically_increasing_id()))
    of = lambda side, name, first, n: rows.select(F.struct("id", F.lit(side).alias("side")).alias("id"), F.col(name).alias("recording"), F.col(first).alias("first"), n.alias("samples"))
    wanted = of("event", "donor", "source_first", F.col("source_samples")).unionByName(of("background", "background", "background_first", F.lit(BACKGROUND_S * rate).cast("long")))
    sounds = cut_out(wanted, chunks.where(F.octet_length("sound") > 0)).select("id.id", "id.side", "sound")
    both = sounds.groupBy("id").agg(*(F.max(F.when(F.col("side") == s, F.col("sound"))).alias(s) for s in ("event", "background")))
    ready = rows.drop("donor", "background").join(both, "id").select("key", "onset_s", "source_samples", "level_db", "contrast_db", "event", "background")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                event, below = (np.frombuffer(row[s] or b"", np.uint8) / 128.0 - 1.0 for s in ("event", "background"))
                if len(event) != row["source_samples"] or len(below) != BACKGROUND_S * rate:
                    raise ValueError(f"too few samples for {row['key']}")
                made = overlaid(below, event, round(row["onset_s"] * rate), row["level_db"], row["contrast_db"], rate)
                yield pa.RecordBatch.from_pylist(
                    [
                        {"key": row["key"], "label": label, "onset_s": row["onset_s"], "end_s": row["onset_s"] + len(event) / rate, "digest": hashlib.sha256(x.tobytes()).hexdigest(), "samples": x}
                        for label, x in zip(("positive", "negative"), made, strict=True)
                    ],
                    schema=pa.schema([("key", pa.string()), ("label", pa.string()), ("onset_s", pa.float64()), ("end_s", pa.float64()), ("digest", pa.string()), ("samples", pa.list_(pa.float32()))]),
                )

    parents = rows.select("key", "donor", "background").distinct()
    return ready.mapInArrow(run, RECORD).join(parents, "key")
