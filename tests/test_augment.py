"""Augmented recordings against NumPy, byte for byte, in any partitioning."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from emberline.operators.augment import augmented

SCHEMA = "name string, samples array<float>, channels int, intervals array<struct<start:double,end:double>>"
RECIPES = [("same", 0.0, 0.0), ("loud", 9.5, 0.0125), ("soft", -12.0, 0.001)]


def test_against_numpy(spark):
    r = np.random.default_rng(1)
    clips = {f"c{k}": (r.normal(size=(50 + k, 1 + k % 2)).astype(np.float32), [(0.001 * k, 0.01), (0.5, 0.75)]) for k in range(6)}
    df = spark.createDataFrame([(n, x.ravel().tolist(), x.shape[1], i) for n, (x, i) in clips.items()], SCHEMA)
    for parts in (1, 4):
        got = augmented(df.repartition(parts), RECIPES).collect()
        assert len(got) == 18
        for row in got:
            x, spans = clips[row.name]
            gain, delay = next((g, d) for n, g, d in RECIPES if n == row.recipe)
            back = round(delay * 16_000)
            want = np.pad(np.clip(x * np.float32(10 ** (gain / 20)), -1, 1), ((back, 0), (0, 0)))
            assert np.array(row.samples, np.float32).tobytes() == want.astype(np.float32).tobytes() and row.delay_samples == back and row.channels == x.shape[1]
            assert [t for i in row.intervals for t in (i.start, i.end)] == pytest.approx([t + back / 16_000 for span in spans for t in span])


@pytest.mark.parametrize("bad", [([], 1), (None, 1), ([0.1, float("nan")], 1), ([float("inf")], 1), ([0.1, 0.2, 0.3], 3), ([None], 1)])
def test_bad_recordings_fail(spark, bad):
    df = spark.createDataFrame([("x", *bad, None)], SCHEMA)
    with pytest.raises(PySparkException, match="finite samples"):
        augmented(df, RECIPES).collect()
