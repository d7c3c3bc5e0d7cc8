"""A fitted transform of two parts: columns, and a vector's leading components.

All parameters are data: medians, weighted means and scales of the columns, the
components of a bounded sample of vectors, and the components' own means and
scales.  The sample is the rows with the least hashes of their keys, so a refit
gives the same components however the rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forest import matrix
from .quantiles import exact_quantiles

#: Rows that components are fitted on, at most; a documented bound of the model.
SAMPLE = 8000


@dataclass
class TwoPart:
    columns: list[str]
    medians: list[float]
    means: list[float]
    scales: list[float]
    centre: list[float]
    components: list[list[float]]
    part_means: list[float]
    part_scales: list[float]
    clip: float = 8.0

    def names(self) -> list[str]:
        return [*self.columns, *(f"component_{k}" for k in range(len(self.components)))]

    def as_dict(self) -> dict:
        """For a store; ``TwoPart(**saved)`` is the same transform again."""
        return asdict(self)

    def values(self, x: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        filled = np.where(np.isnan(x), self.medians, x)
        parts = (vectors - np.array(self.centre)) @ np.array(self.components).reshape(-1, len(self.centre)).T
        both = np.column_stack([(filled - self.means) / self.scales, (parts - self.part_means) / self.part_scales])
        return np.clip(both, -self.clip, self.clip)


def _spread(rows: DataFrame, columns: Sequence[str], weight: str, fill: Sequence[float]) -> tuple[list[float], list[float]]:
    """Weighted means and deviations; a column without spread has scale 1.  Sums are taken
    about the fill value first and about the mean then, so that large values cancel nothing."""
    value = [F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(f)) for c, f in zip(columns, fill, strict=True)]
    w = F.col(weight)
    first = rows.agg(F.sum(w).alias("w"), *(F.sum(w * (v - f)).alias(f"s{i}") for i, (v, f) in enumerate(zip(value, fill, strict=True)))).first()
    if not first.w:
        raise ValueError("no weighted rows to fit on")
    means = [f + first[f"s{i}"] / first.w for i, f in enumerate(fill)]
    second = rows.agg(*(F.sum(w * (v - m) * (v - m)).alias(f"s{i}") for i, (v, m) in enumerate(zip(value, means, strict=True)))).first()
    scales = [(second[i] / first.w) ** 0.5 for i in range(len(columns))]
    return means, [s if s > 1e-9 else 1.0 for s in scales]


def sampled_components(rows: DataFrame, key: str, vector: str, count: int, sample: int = SAMPLE) -> tuple[list[float], list[list[float]]]:
    """Centre and leading components (greatest entry positive) of the ``sample`` rows with the
    least hashes; these are brought to one task, in order of their keys."""
    least = rows.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL").orderBy(F.xxhash64("k"), "k").limit(sample)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        own = pa.Table.from_batches(held).sort_by("k")
        x = np.array(own["v"].to_pylist(), float)
        centre = x.mean(axis=0)
        values, vectors = np.linalg.eigh((x - centre).T @ (x - centre) / max(1, len(x) - 1))
        lead = vectors[:, np.argsort(-values, kind="stable")[:count]].T
        lead = lead * np.sign(lead[np.arange(len(lead)), np.abs(lead).argmax(axis=1)])[:, None]
        yield pa.RecordBatch.from_arrays([pa.array([centre.tolist()]), pa.array([lead.tolist()])], ["centre", "components"])

    found = least.coalesce(1).mapInArrow(fit, "centre array<double>, components array<array<double>>").first()
    if found is None:
        raise ValueError("no vectors to fit components on")
    return list(found.centre), [list(c) for c in found.components]


def fit_two_part(rows: DataFrame, key: str, columns: Sequence[str], vector: str, count: int = 8, weight: str | None = None, sample: int = SAMPLE) -> TwoPart:
    """The transform of training ``rows``; medians count rows alike, means and scales by ``weight``."""
    columns = list(columns)
    own = rows.withColumn("_w", F.lit(1.0) if weight is None else F.col(weight).cast("double"))
    medians = [m[0] if m[0] is not None else 0.0 for m in exact_quantiles(own, columns, [0.5]).values()]
    means, scales = _spread(own, columns, "_w", medians)
    centre, components = sampled_components(own, key, vector, count, sample)
    model = TwoPart(columns, medians, means, scales, centre, components, [0.0] * len(components), [1.0] * len(components), clip=float("inf"))
    parts = two_part(own, model, vector, ["_w"])
    names = model.names()[len(columns) :]
    model.part_means, model.part_scales = _spread(parts, names, "_w", [0.0] * len(names))
    model.clip = 8.0
    return model


def two_part(df: DataFrame, model: TwoPart, vector: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns with :meth:`TwoPart.names`, a matrix product a batch; a null vector counts as the centre."""
    keep = list(keep)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]
    width, names = len(model.columns), model.names()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(len(keep) + width)
            v = np.array([model.centre if x is None else x for x in held.to_pylist()], float).reshape(batch.num_rows, len(model.centre))
            z = model.values(matrix(batch, len(keep), width), v)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keep))), *(pa.array(z[:, c]) for c in range(z.shape[1]))], [*keep, *names])

    rows = df.select(*keep, *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(model.columns)), F.col(vector).cast("array<double>").alias("_v"))
    return rows.mapInArrow(run, ", ".join([*kinds, *(f"`{n}` double" for n in names)]))
