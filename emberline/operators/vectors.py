"""Embedding features, fitted transforms and linear and tree scoring."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.scalars import cosine_distance, logistic, norm

from .quantiles import exact_quantiles

# Groups of which what is new, and what stays, are features.
INTRODUCED, PERSISTENT = ("vocal_alarm", "noise"), ("music", "singing")


def neighbours(df: DataFrame, group: str, order: str, vector: str) -> DataFrame:
    """``before`` and ``after``: the vectors one row earlier and later in order."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("before", F.lag(vector).over(w)).withColumn("after", F.lead(vector).over(w))


def contrast(event: Column, before: Column, after: Column) -> Column:
    """The event, and what it adds to what is before and after it."""
    minus = lambda b: F.zip_with(event, b, lambda x, y: x - y)
    return F.concat(event, minus(before), minus(after))


def context_distances(df: DataFrame, event: str, before: str, after: str) -> DataFrame:
    """Cosine distances and log norm ratios of an event to its surroundings."""
    e, b, a = F.col(event), F.col(before), F.col(after)
    ratio = lambda x, y: F.ln(F.greatest(norm(x), F.lit(1e-12)) / F.greatest(norm(y), F.lit(1e-12)))
    return df.select("*", cosine_distance(e, b).alias("from_before"), cosine_distance(e, a).alias("from_after"), cosine_distance(b, a).alias("around"), ratio(e, b).alias("rise"), ratio(e, a).alias("fall"))


def context_features(df: DataFrame, head: Sequence[Sequence[float]], bias: Sequence[float], groups: dict[str, Sequence[int]], opening: int = 20, step_s: float = 0.05) -> DataFrame:
    """The 32 ``ctx_`` features of ``event``, ``before`` and ``after`` vectors and
    ``position_s``: whether the event opens the clip, distances and norms, and of each
    group of categories the greatest score at the event, its rise and its fall, for
    some groups also what is new or what stays.  ``head`` has a row of weights for
    each category, over a vector's first entries."""
    e, b, a = F.col("event"), F.col("before"), F.col("after")
    middle = F.zip_with(b, a, lambda x, y: (x + y) / 2.0)
    ratio = lambda x, y: F.ln((norm(x) + 1e-6) / (norm(y) + 1e-6))
    out = {
        "ctx_boundary_opening": (F.rint(F.col("position_s") / step_s) <= opening).cast("double"),
        "ctx_embedding_before_event_distance": cosine_distance(b, e), "ctx_embedding_event_after_distance": cosine_distance(e, a),
        "ctx_embedding_before_after_distance": cosine_distance(b, a), "ctx_embedding_context_event_distance": cosine_distance(middle, e),
        "ctx_embedding_event_before_log_norm": ratio(e, b), "ctx_embedding_event_after_log_norm": ratio(e, a),
    }
    score = lambda v, k: logistic(sum((F.get(v, F.lit(j)) * w for j, w in enumerate(head[k])), F.lit(float(bias[k]))))
    best = lambda v, own: F.greatest(*(score(v, k) for k in own)) if len(own) > 1 else score(v, own[0])
    scored = df.select("*", *(best(v, own).alias(f"_{name}_{at}") for name, own in groups.items() for at, v in (("e", e), ("b", b), ("a", a))))
    at = lambda name, where: F.col(f"_{name}_{where}")
    for name in groups:
        out |= {f"ctx_semantic_{name}_event": at(name, "e"), f"ctx_semantic_{name}_rise": at(name, "e") - at(name, "b"), f"ctx_semantic_{name}_fall": at(name, "e") - at(name, "a")}
    out |= {f"ctx_semantic_{name}_introduced": at(name, "e") * (1.0 - at(name, "b")) for name in INTRODUCED if name in groups}
    out |= {f"ctx_semantic_{name}_persistent": F.least(at(name, "b"), at(name, "e")) for name in PERSISTENT if name in groups}
    return scored.select("*", *(out[n].alias(n) for n in sorted(out))).drop(*(f"_{name}_{w}" for name in groups for w in "eba"))


def group_means(vector: Column, groups: Sequence[Sequence[int]]) -> Column:
    """Mean of the entries of each index group."""
    return F.array(*(sum((F.get(vector, F.lit(i)).cast("double") for i in g), F.lit(0.0)) / len(g) for g in groups))


def fit_scaler(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """One row: each column's interpolated median, and weighted mean and population
    deviation after imputing it; no spread gives scale 1.  Medians are exact, by six
    passes of bounded counters."""
    found = exact_quantiles(df, columns, [0.5])
    held = df.select("*", *(F.lit(found[c][0]).cast("double").alias(f"{c}_median") for c in columns))
    w = F.col(weight) if weight else F.lit(1.0)
    filled = {c: F.coalesce(F.nanvl(F.col(c), F.lit(None)), F.col(f"{c}_median")) for c in columns}
    sums = held.agg(*(F.max(f"{c}_median").alias(f"{c}_median") for c in columns), *((F.sum(w * x) / F.sum(w)).alias(f"{c}_mean") for c, x in filled.items()), *((F.sum(w * x * x) / F.sum(w)).alias(f"{c}_square") for c, x in filled.items()))
    def scale(c: str) -> Column:
        spread = F.sqrt(F.greatest(F.col(f"{c}_square") - F.col(f"{c}_mean") * F.col(f"{c}_mean"), F.lit(0.0)))
        return F.when(spread > 1e-9, spread).otherwise(1.0).alias(f"{c}_scale")
    return sums.select(*(f"{c}_median" for c in columns), *(f"{c}_mean" for c in columns), *(scale(c) for c in columns))


def standardise(df: DataFrame, fitted: DataFrame, columns: Sequence[str], clip: float | None = None) -> DataFrame:
    """Impute the median, centre, scale, and hold within ``clip``."""
    out = df.crossJoin(F.broadcast(fitted))
    for c in columns:
        z = (F.coalesce(F.nanvl(F.col(c), F.lit(None)), F.col(f"{c}_median")) - F.col(f"{c}_mean")) / F.col(f"{c}_scale")
        out = out.withColumn(c, F.greatest(F.lit(-clip), F.least(F.lit(clip), z)) if clip else z)
    return out.select(*df.columns)


def linear_margin(columns: Sequence[str], coefficients: Sequence[float], intercept: float) -> Column:
    """The margin of a linear model over named columns."""
    if len(columns) != len(coefficients):
        raise ValueError("a coefficient for each column")
    return sum((F.col(c) * F.lit(float(w)) for c, w in zip(columns, coefficients, strict=True)), F.lit(float(intercept)))


def tree_value(nodes: Sequence[dict], at: int = 0) -> Column:
    """A tree as nested conditions: ``x <= threshold`` goes left.  ``nodes`` have
    ``leaf, value, feature, threshold, left, right``."""
    n = nodes[at]
    if n["leaf"]:
        return F.lit(float(n["value"]))
    return F.when(F.col(n["feature"]) <= F.lit(float(n["threshold"])), tree_value(nodes, n["left"])).otherwise(tree_value(nodes, n["right"]))


def forest_margin(trees: Sequence[Sequence[dict]], base: float = 0.0) -> Column:
    return sum((tree_value(t) for t in trees), F.lit(float(base)))


def project(vector: Column, mean: Sequence[float], components: Sequence[Sequence[float]]) -> Column:
    """``(x - mean)`` on each component; the matrix is a small fitted parameter."""
    centred = F.zip_with(vector, F.array(*map(F.lit, map(float, mean))), lambda x, m: x - m)
    return F.array(*(F.aggregate(F.zip_with(centred, F.array(*map(F.lit, map(float, c))), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x) for c in components))


def fit_components(df: DataFrame, vector: str, k: int) -> tuple[list[float], list[list[float]], list[float]]:
    """Mean, leading components (largest entry positive) and their variances.

    Each task adds up its vectors' products as one matrix; the matrices are added
    in Spark, so only a square of the vector's length reaches the driver.
    """
    d = df.select(F.size(vector).alias("d")).first().d
    # a row of ones beside the vectors gives their sums and number as well
    size = d + 1

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros((size, size))
        for batch in batches:
            x = np.ones((batch.num_rows, size))
            x[:, :d] = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, d)
            whole += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(whole.ravel())], ["i", "s"])

    vectors_ = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    sums = np.zeros(size * size)
    for r in vectors_.mapInArrow(products, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        sums[r.i] = r.s
    sums = sums.reshape(size, size)
    mean = sums[d, :d] / sums[d, d]
    values, vectors = np.linalg.eigh(sums[:d, :d] / sums[d, d] - np.outer(mean, mean))
    lead = vectors[:, ::-1][:, :k].T
    lead *= np.sign(lead[np.arange(k), np.abs(lead).argmax(axis=1)])[:, None]
    return mean.tolist(), lead.tolist(), values[::-1][:k].tolist()
