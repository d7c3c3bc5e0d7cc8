"""Time-series operators on frames: one row per clip and frame, in frame order.

Every window is partitioned by clip, whose timeline is bounded, so all
operators of one query share one shuffle by clip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.scalars import db_power, dot, hellinger, logistic, power_db

# The level floor, the level offset, and the selection score's
# centres, widths and powers (event level, jump, jump in robust deviations).
FLOOR = -90.0
OFFSET = -0.691
EVENT = (-10.5, 2.5, 0.9)
JUMP = (13.0, 3.5, 1.25)
ROBUST = (6.0, 2.0, 0.65, 0.35)
MAD_SCALE, LEAST_MAD = 1.4826, 2.0
# Least level of an event, and its least distance from the baseline.
LOUD = (-13.0, 9.0)


def ordered(clip: str = "clip", frame: str = "frame") -> Window:
    return Window.partitionBy(clip).orderBy(frame)


def span(first: int, last: int, clip: str = "clip", frame: str = "frame") -> Window:
    return ordered(clip, frame).rowsBetween(first, last)


def number_frames(df: DataFrame, clip: str, order: list[str]) -> DataFrame:
    """``frame`` from 0 in order and ``n``, the clip's frames."""
    own = Window.partitionBy(clip)
    return df.withColumn("frame", F.row_number().over(own.orderBy(*order)) - 1).withColumn("n", F.count(F.lit(1)).over(own))


def level(value: Column) -> Column:
    return F.greatest(F.lit(FLOOR), power_db(value))


def percentile_or_floor(c: str, q: float, w: Window | None = None) -> Column:
    """Linearly interpolated percentile; the floor where there is nothing."""
    p = F.percentile(c, F.lit(q))
    return F.coalesce(p.over(w) if w is not None else p, F.lit(FLOOR))


def tumbling_levels(df: DataFrame, value: str, size: int, clip: str = "clip") -> DataFrame:
    """Level, peak and clipped share of each whole block of ``size`` frames; a
    trailing partial block is dropped."""
    x = F.col(value)
    return (
        df.groupBy(clip, F.floor(F.col("frame") / size).cast("long").alias("block"))
        .agg(F.count(F.lit(1)).alias("frames"), F.avg(x * x).alias("power"), F.max(F.abs(x)).alias("peak"), F.avg((F.abs(x) >= 10 ** (-1 / 20)).cast("double")).alias("clipped"))
        .where(F.col("frames") == size)
        .withColumn("level", F.greatest(F.lit(FLOOR), OFFSET + power_db(F.col("power"))))
        .drop("frames", "power")
    )


def scored(frame: str = "frame", n: str = "n") -> Column:
    """Frames with enough before and after them to be judged."""
    return (F.col(frame) >= 22) & (F.col(frame) < F.col(n) - 5)


def trailing_baseline(df: DataFrame) -> DataFrame:
    """Median of the rows 60 to 3 before, and the level's jump over it."""
    return df.withColumn("baseline", F.percentile("level", F.lit(0.5)).over(span(-60, -3))).withColumn("jump", F.col("level") - F.col("baseline"))


def trailing_mad(df: DataFrame) -> DataFrame:
    """Median absolute deviation from the trailing baseline over its own rows."""
    held = F.collect_list("level").over(span(-60, -3))
    return df.withColumn("mad", _middle(F.array_sort(F.transform(held, lambda x: F.abs(x - F.col("baseline"))))))


def _middle(values: Column) -> Column:
    """Median of a sorted array."""
    k = F.size(values)
    return (F.get(values, F.floor((k - 1) / 2).cast("int")) + F.get(values, F.floor(k / 2).cast("int"))) / 2.0


def horizons(df: DataFrame, event: str = "event", sizes: tuple[int, ...] = (10, 20, 60, 120)) -> DataFrame:
    """Over the ``h`` rows that end two rows before: the median level (the floor
    without rows), the median absolute deviation from it (0) and the event's jump."""
    for h in sizes:
        w = span(-h - 2, -3)
        base, held = F.col(f"baseline_{h}"), F.col("_held")
        df = df.withColumn(f"baseline_{h}", F.coalesce(F.percentile("level", F.lit(0.5)).over(w), F.lit(FLOOR))).withColumn("_held", F.collect_list("level").over(w))
        off = F.array_sort(F.transform(held, lambda x: F.abs(x - base)))  # noqa: B023
        df = df.withColumn(f"mad_{h}", F.coalesce(_middle(off), F.lit(0.0))).withColumn(f"jump_{h}", F.col(event) - base).drop("_held")
    return df


def forward_quartile(df: DataFrame, sizes: tuple[int, ...] = (2, 6, 12, 20)) -> DataFrame:
    """Lower quartile of this row and those after it."""
    for k in sizes:
        df = df.withColumn(f"p25_{k}", F.percentile("level", F.lit(0.25)).over(span(0, k - 1)))
    return df


def selection_score(event: Column, jump: Column, mad: Column) -> Column:
    """Product of three sigmoids: event level, jump, and jump in robust deviations."""
    robust = jump / F.greatest(F.lit(LEAST_MAD), MAD_SCALE * mad)
    sigmoid = lambda x, by: F.pow(logistic((x - by[0]) / by[1]), F.lit(by[2]))
    return sigmoid(event, EVENT) * sigmoid(jump, JUMP) * (ROBUST[2] + ROBUST[3] * logistic((robust - ROBUST[0]) / ROBUST[1]))


def differences(df: DataFrame) -> DataFrame:
    """Of the 60 rows before: rises of 8 dB or more from row to row, quartile spread
    of the levels, median absolute change; 0 without rows."""
    levels, changes = span(-60, -1), span(-59, -1)
    quartile = lambda q: F.percentile("level", F.lit(q)).over(levels)
    return (
        df.withColumn("change", F.col("level") - F.lag("level").over(ordered()))
        .withColumn("rises", F.coalesce(F.sum(F.when(F.col("change") >= 8, 1).otherwise(0)).over(changes), F.lit(0)))
        .withColumn("spread", F.coalesce(quartile(0.75) - quartile(0.25), F.lit(0.0)))
        .withColumn("_size", F.abs("change")).withColumn("derivative", F.coalesce(F.percentile("_size", F.lit(0.5)).over(changes), F.lit(0.0))).drop("_size")
    )


def loud(baseline: Column) -> Column:
    """The level from which an event holds: 9 dB over its baseline, and not below -13."""
    return F.greatest(F.lit(LOUD[0]), baseline + LOUD[1])


def persistence(df: DataFrame) -> DataFrame:
    """Share of 20 rows that are :func:`loud`, mean excess over the baseline of 60 rows."""
    ahead = F.collect_list("level").over(span(0, 19))
    longer = F.collect_list("level").over(span(0, 59))
    share = F.aggregate(ahead, F.lit(0.0), lambda a, x: a + F.when(x >= loud(F.col("baseline")), 1.0).otherwise(0.0)) / F.size(ahead)
    excess = F.aggregate(longer, F.lit(0.0), lambda a, x: a + F.greatest(x - F.col("baseline"), F.lit(0.0))) / F.size(longer)
    return df.withColumn("held", share).withColumn("excess", excess)


def moving_power(df: DataFrame, before: int = 50, after: int = 5) -> DataFrame:
    """Mean power before and from this row on, and their ratio in dB."""
    p = db_power(F.col("level"))
    df = df.withColumn("_p", p)
    df = df.withColumn("power_before", F.avg("_p").over(span(-before, -1))).withColumn("power_after", F.avg("_p").over(span(0, after - 1)))
    return df.withColumn("rise_db", power_db(F.col("power_after"), 1e-12) - power_db(F.col("power_before"), 1e-12)).drop("_p")


def around(df: DataFrame, points: DataFrame, before: int, after: int) -> DataFrame:
    """Rows of each clip from ``before`` rows before its ``point`` to ``after`` rows
    from it, the last one excluded."""
    at = F.col("frame") - F.col("point")
    return df.join(points.select("clip", "point"), "clip").where((at >= -before) & (at < after))


def moving_peaks(df: DataFrame, points: DataFrame, sizes: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """The largest moving mean of the power from 5 rows before each clip's point to
    40 rows from it, whole windows only, in dB; of shorter stretches the largest power."""
    df = around(df, points, 5, 40).withColumn("_p", db_power(F.col("level")))
    for k in sizes:
        w = span(-k + 1, 0)
        df = df.withColumn(f"_m{k}", F.when(F.count("_p").over(w) == k, F.avg("_p").over(w)))
    return df.groupBy("clip", "point").agg(*(power_db(F.coalesce(F.max(f"_m{k}"), F.max("_p"))).alias(f"peak_{k}") for k in sizes))


def first_best(df: DataFrame, value: str, groups: list[str], order: str = "frame") -> DataFrame:
    """The row with the greatest value of each group, the first on a tie."""
    rest = [c for c in df.columns if c not in groups]
    return df.groupBy(*groups).agg(F.min_by(F.struct(*rest), F.struct(-F.col(value), F.col(order))).alias("_b")).select(*groups, "_b.*")


def run_length(df: DataFrame, threshold: Column, limit: int = 120, step: float = 0.05) -> DataFrame:
    """Seconds from each row on that the level holds the threshold, one miss
    allowed; two misses in a row end the run."""
    ahead = F.collect_list("level").over(span(0, limit - 1))
    start = F.struct(F.lit(0).alias("length"), F.lit(0).alias("at"), F.lit(0).alias("misses"), F.lit(False).alias("over"))

    def go(a: Column, x: Column) -> Column:
        at = a["at"] + 1
        hit = x >= threshold
        misses = F.when(hit, 0).otherwise(a["misses"] + 1)
        return F.when(a["over"], a).otherwise(F.struct(F.when(hit, at).otherwise(a["length"]).alias("length"), at.alias("at"), misses.alias("misses"), (misses >= 2).alias("over")))

    return df.withColumn("run_s", F.aggregate(ahead, start, go, lambda a: a["length"].cast("double") * step))


def peak_run(df: DataFrame, points: DataFrame) -> DataFrame:
    """The stretch around the first peak of the 30 rows from each clip's point on whose
    levels hold 10 dB under the peak and 6 dB over the median of the rows 300 to 6
    before: the peak, rows of it to the left (10 before the point at most) and right
    (within 200 rows from the point)."""
    near = around(df.select("clip", "frame", "level"), points, 300, 200)
    at = F.col("frame") - F.col("point")
    found = near.groupBy("clip", "point").agg(
        F.coalesce(F.percentile(F.when(at < -5, F.col("level")), F.lit(0.5)), F.lit(FLOOR)).alias("baseline"),
        F.min(F.when((at >= 0) & (at < 30), F.struct((-F.col("level")).alias("low"), "frame"))).alias("_b"), F.max("frame").alias("_last"), F.min("frame").alias("_first"),
    ).select("clip", "point", "baseline", F.col("_b.frame").alias("peak_frame"), (-F.col("_b.low")).alias("peak"), "_last", "_first")
    low = F.col("level") < F.greatest(F.col("baseline") + 6, F.col("peak") - 10)
    before, after = (at >= -10) & (F.col("frame") < F.col("peak_frame")), F.col("frame") > F.col("peak_frame")
    edge = F.greatest(F.col("_first"), F.col("point") - 10)
    return near.join(found, ["clip", "point"]).groupBy("clip", "point", "baseline", "peak_frame", "peak").agg(
        (F.col("peak_frame") - F.coalesce(F.max(F.when(low & before, F.col("frame"))) + 1, F.max(edge))).alias("left"),
        (F.coalesce(F.min(F.when(low & after, F.col("frame"))), F.max("_last") + 1) - F.col("peak_frame") - 1).alias("right"),
    )


def autocorrelation(df: DataFrame, low: int = 20, high: int = 150, least: int = 60) -> DataFrame:
    """Largest normalised autocorrelation over lags of the rises, each weighted by a
    sigmoid of the level it reaches; null for clips with fewer than ``least`` rises,
    0 where no lag correlates.  Lags stay below half the rises."""
    weight = logistic((F.col("level") + 25.0) / 6.0)
    change = df.select("clip", "frame", weight.alias("_w"), (F.col("level") - F.lag("level").over(ordered())).alias("_c")).where("_c is not null")
    rise = change.select("clip", "frame", (F.greatest(F.col("_c"), F.lit(0.0)) * F.col("_w")).alias("rise"))
    held = rise.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("frame", "rise"))).alias("s")).select("clip", F.transform("s", lambda r: r["rise"]).alias("d"))
    n = F.size("d")
    last = F.least(F.lit(high), F.floor(n / 2).cast("int") - 1)
    each = held.withColumn("k", F.explode_outer(F.when(last >= low, F.sequence(F.lit(low), last))))
    a, b = F.slice("d", F.lit(1), n - F.col("k")), F.slice("d", F.col("k") + 1, n - F.col("k"))
    sized = each.select("clip", n.alias("n"), dot(a, b).alias("ab"), (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))).alias("norms"))
    best = F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(F.col("norms") > 1e-8, F.col("ab") / F.col("norms"))), F.lit(0.0)))
    return sized.groupBy("clip", "n").agg(best.alias("best")).select("clip", F.when(F.col("n") >= least, F.col("best")).alias("rhythm"))


def recurrence(df: DataFrame, profile: str = "profile", far: int = 160, near: int = 10, step: int = 5) -> DataFrame:
    """Hellinger distance of each row's and its next row's mean profile to the nearest
    of every fifth profile from 160 rows before (or the first) to 11 rows before."""
    held = df.withColumn("_next", F.lead(profile).over(ordered())).withColumn("_h", F.collect_list(F.struct(F.col("frame").alias("frame"), F.col(profile).alias("p"))).over(span(-far, -near - 1)))
    event = F.when(F.col("_next").isNull(), F.col(profile)).otherwise(F.zip_with(profile, "_next", lambda x, y: (x + y) / 2.0))
    held = held.withColumn("_e", event)
    first = F.greatest(F.lit(0), F.col("frame") - far)
    return held.withColumn("recurrence", F.array_min(F.transform(F.filter("_h", lambda x: (x["frame"] - first) % step == 0), lambda x: hellinger(F.col("_e"), x["p"])))).drop("_next", "_h", "_e")
