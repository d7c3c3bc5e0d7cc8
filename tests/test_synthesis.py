"""Synthetic records against loops over whole recordings, in any partitioning."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from emberline.operators.synthesis import cut_out, faded, overlaid, synthetic_events, synthetic_plan
from emberline.operators.tables import numbered

RATE = 1_000


def uniform(*parts) -> float:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def whole(*parts) -> int:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


@pytest.fixture(scope="module")
def recordings():
    r = np.random.default_rng(5)
    return {f"r{k}": r.integers(0, 256, 9_000 + 1_500 * k, dtype=np.uint8) for k in range(8)}


def tables(spark, recordings):
    chunks = [(n, p, bytearray(x[a : a + 700].tobytes())) for n, x in recordings.items() for p, a in enumerate(range(0, len(x), 700))]
    chunks += [("r0", 1_000, None), ("r0", -1, bytearray())]
    donors = [("r0", [(1.0, 3.0), (4.0, 4.5)], None), ("r1", [(2.0, 2.4)], 0.1)]
    backgrounds = [(n, len(x)) for n, x in recordings.items() if n > "r1"]
    return (
        spark.createDataFrame(donors, "donor string, intervals array<struct<start_s:double,end_s:double>>, error_s double"),
        spark.createDataFrame(backgrounds, "background string, samples long"),
        spark.createDataFrame(chunks, "recording string, part long, sound binary"),
    )


def expected(recordings, donor, intervals, error, variant):
    long = sorted(n for n, x in recordings.items() if n > "r1" and len(x) >= 12 * RATE)
    name = long[whole("background1", donor, variant) % len(long)]
    first = whole("offset1", donor, variant) % max(1, len(recordings[name]) - 12 * RATE)
    start, end = intervals[variant % len(intervals)]
    low, high = start + error, end - error
    seconds = min([0.35, 0.75, 1.5][variant % 3], high - low)
    at = low + uniform("source1", donor, variant) * max(0.0, high - seconds - low)
    onset = 3.0 + 5.0 * uniform("onset1", donor, variant)
    event = [float(b) / 128 - 1 for b in recordings[donor][round(at * RATE) : round((at + seconds) * RATE)]]
    below = [float(b) / 128 - 1 for b in recordings[name][first : first + 12 * RATE]]
    rms = lambda x: math.sqrt(sum(v * v for v in x) / len(x))
    gain = min(10 ** ([-12, -6, -3][variant % 3] / 20) / rms(event), 0.98 / max(map(abs, event)))
    event = [v * gain for v in event]
    quieter = min(rms(event) / 10 ** ([10, 20, 30][variant // 3 % 3] / 20) / rms(below), 0.98 / max(map(abs, below)))
    below = [v * quieter for v in below]
    ramp = np.linspace(0, 1, 5)
    shape = [1.0] * len(event)
    for i in range(5):
        shape[i] = shape[-1 - i] = ramp[i]
    out = list(below)
    for i, v in enumerate(event):
        k = round(onset * RATE) + i
        out[k] = below[k] * (1 - shape[i]) + v * shape[i]
    return name, onset, len(event), out, below


def test_records_against_loops(spark, recordings):
    donors, backgrounds, chunks = tables(spark, recordings)
    results = []
    for parts in (1, 5):
        plan = synthetic_plan(donors.repartition(parts), backgrounds.repartition(parts), rate=RATE)
        rows = synthetic_events(plan, chunks.repartition(parts), rate=RATE).collect()
        results.append(sorted((r.key, r.label, r.digest) for r in rows))
        assert len(rows) == 48
        for r in rows:
            donor, variant = r.key.split(":")
            intervals, error = {"r0": ([(1.0, 3.0), (4.0, 4.5)], 0.05), "r1": ([(2.0, 2.4)], 0.1)}[donor]
            name, onset, length, positive, control = expected(recordings, donor, intervals, error, int(variant))
            assert (r.donor, r.background) == (donor, name) and r.onset_s == pytest.approx(onset) and r.end_s == pytest.approx(onset + length / RATE)
            assert np.allclose(r.samples, positive if r.label == "positive" else control, atol=1e-6)
            assert max(map(abs, r.samples)) <= 0.9801
    assert results[0] == results[1]


def test_what_a_plan_refuses(spark, recordings):
    donors, backgrounds, chunks = tables(spark, recordings)
    with pytest.raises(PySparkException, match="no background"):
        synthetic_plan(donors, backgrounds.where("samples < 5"), rate=RATE).collect()
    with pytest.raises(PySparkException, match="no interval"):
        synthetic_plan(donors.withColumn("intervals", F.slice("intervals", 1, 0)), backgrounds, rate=RATE).collect()
    with pytest.raises(PySparkException, match="within its errors"):
        synthetic_plan(donors.withColumn("error_s", F.lit(0.25)), backgrounds, rate=RATE).collect()
    plan = synthetic_plan(donors, backgrounds, rate=RATE)
    with pytest.raises(PySparkException, match="too few samples"):
        synthetic_events(plan, chunks.where("recording <> 'r1'"), rate=RATE).collect()
    assert synthetic_events(plan.where("false"), chunks, rate=RATE).collect() == []


def test_fade_and_fit():
    for n in range(2, 40):
        steps = min(5, n // 2)
        want = np.ones(n)
        want[:steps], want[-steps:] = np.linspace(0, 1, steps), np.linspace(1, 0, steps)
        # a fade of one step is silent on both sides; its last sample is one where it falls
        got = faded(n, RATE)
        assert np.allclose(got[:steps], want[:steps]) and np.allclose(got[steps:-steps], 1) and np.allclose(got, got[::-1])
    for first in (-1, 95):
        with pytest.raises(ValueError, match="fit"):
            overlaid(np.ones(100), np.ones(10), first, -6, 10)
    with pytest.raises(ValueError, match="silent"):
        overlaid(np.ones(100), np.zeros(10), 5, -6, 10)


def test_cut_out_and_numbers(spark):
    data = bytes(range(250))
    chunks = spark.createDataFrame([("a", p, bytearray(data[p * 7 : p * 7 + 7])) for p in range(36)], "recording string, part long, sound binary").repartition(5)
    wanted = [(k, "a", 3 * k, k) for k in range(1, 60)] + [(100, "none", 0, 5), (101, "a", 249, 9), (102, "a", 300, 2)]
    got = {r.id: r.sound for r in cut_out(spark.createDataFrame(wanted, "id long, recording string, first long, samples long"), chunks).collect()}
    assert all(bytes(got[k] or b"") == (data[f : f + n] if name == "a" else b"") for k, name, f, n in wanted)
    rows = numbered(spark.range(1000).repartition(7), "id").collect()
    assert all(r.number == r.id for r in rows) and len(rows) == 1000
    assert numbered(spark.range(0), "id").collect() == []
