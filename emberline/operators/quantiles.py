"""Exact interpolated quantiles of whole columns, in bounded memory.

The bits of a float, put in order, are a number.  A pass counts the next eleven
bits of the values that share the bits found so far; six passes find the value
of a rank.  A task holds 2,048 counters for each column and rank, whatever the
number of rows, and the result doesn't depend on how they are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .forest import matrix

BITS = 11


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the floats."""
    raw = np.ascontiguousarray(x, float).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(raw & top, ~raw, raw | top)


def from_bits(bits: int) -> float:
    raw = bits ^ (1 << 63) if bits >> 63 else ~bits & ((1 << 64) - 1)
    return float(np.array([raw], np.uint64).view(float)[0])


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """Each column's quantiles at ``shares``, interpolated between neighbouring values; null and NaN don't count, and a column of these has None."""
    rows = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)))
    value = lambda i: F.when(~F.isnan(f"x{i}"), F.col(f"x{i}"))
    counts = rows.agg(*(F.count(value(i)).alias(f"n{i}") for i in range(len(columns)))).first()
    # the ranks on both sides of each quantile, from 0
    places = [[(counts[i] - 1) * s for s in shares] if counts[i] else [] for i in range(len(columns))]
    targets = [(i, r) for i, own in enumerate(places) for r in sorted({int(x) for p in own for x in (np.floor(p), np.ceil(p))})]
    prefix, left = [0] * len(targets), [r for _, r in targets]
    done = 0
    while targets and done < 64:
        bits = min(BITS, 64 - done)
        chosen = _digits(rows, targets, prefix, left, done, bits, len(columns))
        for t, digit, below in chosen:
            prefix[t], left[t] = prefix[t] << bits | digit, left[t] - below
        done += bits
    found = {key: from_bits(p) for key, p in zip(targets, prefix, strict=True)}
    out = {}
    for i, c in enumerate(columns):
        pairs = [(found[i, int(np.floor(p))], found[i, int(np.ceil(p))], p - np.floor(p)) for p in places[i]]
        out[c] = [a if a == b else float(a + (b - a) * part) for a, b, part in pairs] or [None] * len(shares)
    return out


def _digits(rows: DataFrame, targets: list[tuple[int, int]], prefix: list[int], left: list[int], done: int, bits: int, width: int) -> list[tuple[int, int, int]]:
    """For each target its next bits, and how many values with its prefix lie below them."""
    shift, mask = 64 - done - bits, (1 << bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(targets), 1 << bits), np.int64)
        for batch in batches:
            x = matrix(batch, 0, width)
            for i in sorted({i for i, _ in targets}):
                key = ordered_bits(x[:, i][~np.isnan(x[:, i])])
                for t, (j, _) in enumerate(targets):
                    if j == i:
                        own = key if not done else key[(key >> np.uint64(64 - done)) == np.uint64(prefix[t])]
                        held[t] += np.bincount(((own >> np.uint64(shift)) & np.uint64(mask)).astype(np.int64), minlength=1 << bits)
        t, d = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(held[t, d])], ["t", "d", "n"])

    sums = rows.mapInArrow(run, "t int, d int, n long").groupBy("t", "d").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("t").orderBy("d"))
    wanted = F.element_at(F.array(*(F.lit(x).cast("long") for x in left)), F.col("t") + 1)
    hit = sums.withColumn("u", upto).where((F.col("u") > wanted) & (F.col("u") - F.col("n") <= wanted))
    return [(r.t, r.d, r.u - r.n) for r in hit.select("t", "d", "u", "n").collect()]
