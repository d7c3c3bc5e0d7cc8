"""Queries without SQL against plain Python and NumPy."""

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

from emberline.operators import selection, signal
from emberline.queries import QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def clips():
    events = pq.read_table(f"{DIR}/events.parquet").to_pandas().sort_values(["user_id", "ts", "event_id"])
    return {int(k): g["value"].to_numpy() for k, g in events.groupby("user_id")}


def test_short_proposals_against_a_loop(spark):
    r = np.random.default_rng(6)
    rows = [(c, f, round(float(r.normal()), 1)) for c in range(6) for f in range(80)]
    originals = [(c, f) for c in range(5) for f in (10, 40)]
    got = selection.short_proposals(spark.createDataFrame(rows, "clip int, frame int, score double"), "score", spark.createDataFrame(originals, "clip int, frame int")).collect()
    for c in range(6):
        own = [f for k, f in originals if k == c]
        chosen = []
        for _, f, s in sorted((x for x in rows if x[0] == c), key=lambda x: (-x[2], x[1])):
            if s > 0 and len(chosen) < 4 and all(abs(f - o) >= 3 for o in own) and all(abs(f - g) >= 10 for g in chosen):
                chosen.append(f)
        assert [x.frame for x in sorted((x for x in got if x.clip == c), key=lambda x: x.rank)] == chosen


def test_components_against_numpy(spark):
    table = pq.read_table(f"{DIR}/embeddings.parquet").to_pandas()
    x = np.stack(table.embedding).astype(float)
    _, _, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = dict(zip(table.vec_id, (x - x.mean(axis=0)) @ v[:4].T, strict=True))
    for r in QUERIES["pca_projection"](spark, DIR).collect():
        assert np.allclose(np.abs(r.projected), np.abs(want[r.vec_id]), atol=1e-4)


def test_filtered_levels_against_one_pass(spark, clips):
    got = QUERIES["iir_level"](spark, DIR).toPandas()
    for clip, values in clips.items():
        x = values / 500
        for section in (signal.high_pass(70.0), signal.high_shelf(1500.0, 4.0)):
            y = np.zeros(len(x))
            b0, b1, b2, a1, a2 = section
            at = lambda v, i: v[i] if i >= 0 else 0.0
            for i in range(len(x)):
                y[i] = b0 * x[i] + b1 * at(x, i - 1) + b2 * at(x, i - 2) - a1 * at(y, i - 1) - a2 * at(y, i - 2)
            x = y
        n = len(x) // 5
        want = np.maximum(-90, -0.691 + 10 * np.log10(np.maximum((x[: 5 * n].reshape(n, 5) ** 2).mean(axis=1), 1e-9)))
        own = got[got["clip"] == clip].sort_values("block")
        assert np.allclose(own.level, want, atol=2e-6)


def test_spectra_against_a_direct_transform(spark, clips):
    got = QUERIES["frame_spectrum"](spark, DIR).toPandas()
    clip = min(clips)
    x = clips[clip][:16] / 500
    window = np.hanning(16)
    power = np.array([abs(sum(x[i] * window[i] * np.exp(-2j * np.pi * k * i / 32) for i in range(16))) ** 2 for k in range(17)]) + 1e-12
    p = power / power.sum()
    own = got[(got["clip"] == clip) & (got.block == 0)].iloc[0]
    assert abs(own.centroid - (p * np.arange(17)).sum()) < 1e-5 and abs(own.flatness - np.exp(np.log(p).mean()) / p.mean()) < 1e-5


def test_bag_fit_separates_bags(spark):
    weights = QUERIES["mil_linear_softmax_fit"](spark, DIR).toPandas()
    assert isinstance(weights, pd.DataFrame) and len(weights) == 3 * 4 and np.isfinite(weights.weight).all()
