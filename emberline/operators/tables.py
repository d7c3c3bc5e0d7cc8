"""Joins that check their keys, projections by name, and the points and windows of feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import EVENT, HORIZONS
from .graph import checkpointed

# Features of a whole clip and of its opening that a compact model takes.
GLOBAL = (
    "duration_s", "global_raw_peak_dbfs", "global_raw_clip_fraction", "global_median_db", "global_dynamic_range_db", "global_derivative_db", "global_loud_fraction", "global_quiet_fraction",
)
OPENING = ("start_position_s", "start_event_db", "start_duration_s", "start_near_clip_fraction", "start_spectral_flatness", "start_spectral_centroid_hz")
#: The event features that a compact model takes: all but the baselines of the horizons and the history's length.
COMPACT = tuple(n for n in EVENT if n != "history_s" and n not in {f"baseline_{h}{kind}_db" for h in HORIZONS for kind in ("", "_mad")})
WINDOW, RATE, ROW_S = 800, 16_000, 0.05


def required(value: Column, ok: Column, message: str) -> Column:
    """``value`` where ``ok`` holds; the job fails with ``message`` where it doesn't."""
    return F.when(ok, value).otherwise(F.raise_error(message))


def numbered(df: DataFrame, *order: str, to: str = "number") -> DataFrame:
    """Rows numbered from 0 in ``order``, which tells all rows apart.  Each range is numbered
    by itself; one row a range says how many come before."""
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")).select("_range", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)).cast("long") - 1
    return ranged.withColumn("_place", place).join(F.broadcast(starts), "_range").withColumn(to, F.col("_place") + F.col("_before")).drop("_range", "_place", "_before")


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Each row of ``left`` with its row of ``right``; a key that is missing there fails
    the job.  The check goes along with the join, so neither side is read again."""
    clash = (set(left.columns) & set(right.columns)) - set(on)
    if clash:
        raise ValueError(f"columns in both tables: {sorted(clash)}")
    marked = right.withColumn("_there", F.lit(True))
    joined = left.join(marked, list(on), "left")
    key = on[0]
    there = required(F.col(key), F.coalesce("_there", F.lit(False)), "a key has no row to join")
    return joined.withColumn(key, there).drop("_there")


def appended(base: DataFrame, more: DataFrame, on: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``base`` with the columns ``names`` of ``more``, which must be all it has."""
    if sorted(set(more.columns) - set(on)) != sorted(names):
        raise ValueError("the columns to append are not the ones declared")
    return checked_join(base, more.select(*on, *names), on)


def with_defaults(positives: DataFrame, index: DataFrame, timings: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Every positive with what the index and the timings say of it, else the defaults."""
    joined = positives.join(index, key, "left").join(timings, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def strict_zip(left: DataFrame, right: DataFrame, group: str, order: str) -> DataFrame:
    """Rows of two tables side by side by place within each group; groups of unequal
    length fail the job."""
    w = Window.partitionBy(group)
    placed = lambda df, n: df.withColumn("place", F.row_number().over(w.orderBy(order))).withColumn(n, F.count(F.lit(1)).over(w))
    rows = placed(left, "_m").drop(order).join(placed(right, "_n").drop(order), [group, "place"], "full")
    return rows.withColumn("place", required(F.col("place"), F.col("_m").eqNullSafe(F.col("_n")), "lengths differ")).drop("_m", "_n")


def one_media(df: DataFrame, selector: str, path: str = "path", file: str = "file") -> DataFrame:
    """The row whose path or file is ``selector``; none or several fail the job."""
    found = df.where((F.col(path) == selector) | (F.col(file) == selector)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    counted = found.withColumn(path, required(F.col(path), F.col("_n") == 1, f"{selector} names several rows")).drop("_n")
    none = df.sparkSession.range(1).select(F.lit(True).alias("_one"))
    kept = none.join(counted.withColumn("_one", F.lit(True)), "_one", "left").drop("_one")
    return kept.withColumn(path, required(F.col(path), F.col(path).isNotNull(), f"{selector} names no row"))


def view_map(records: DataFrame, variant: str, source: str, record: str) -> DataFrame:
    """Each variant's records by source: ``variant, records map<source, record>``; a
    source that a variant holds twice fails the job, as map keys must differ."""
    return records.groupBy(variant).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(source).cast("string"), record)))).alias("records"))


def consistency(df: DataFrame, pair: str, weight: str, value: str) -> DataFrame:
    """Each pair's weighted mean value and weighted squares of the differences from it."""
    own = Window.partitionBy(pair)
    mean = F.sum(F.col(weight) * F.col(value)).over(own) / F.greatest(F.sum(weight).over(own), F.lit(1e-20))
    return df.withColumn("mean", mean).groupBy(pair).agg(F.max("mean").alias("mean"), F.sum(F.col(weight) * F.pow(F.col(value) - F.col("mean"), F.lit(2.0))).alias("spread"))


def parity(df: DataFrame, a: str, b: str, most: float) -> DataFrame:
    """The greatest difference of two scores, and whether it stays within ``most``."""
    return df.agg(F.max(F.abs(F.col(a) - F.col(b))).alias("worst")).withColumn("equal", F.col("worst") <= most)


def ranked_matches(df: DataFrame, query: str = "query") -> DataFrame:
    """Each query's matches in order: confirmed first, then the larger fraction, then
    more anchors, then by reference."""
    w = Window.partitionBy(query).orderBy(F.col("confirmed").desc(), F.col("fraction").desc(), F.col("anchors").desc(), "reference")
    return df.withColumn("place", F.row_number().over(w))


def first_by_path(df: DataFrame, limit: int | None = None, path: str = "path") -> DataFrame:
    """Rows by path, all or the first ``limit``."""
    return df.orderBy(path) if limit is None else df.orderBy(path).limit(limit)


def project_names(values: Column, names: Sequence[str]) -> Column:
    """The named entries of a map as an array; missing ones are NaN."""
    return F.array(*(F.coalesce(F.element_at(values, n), F.lit(float("nan"))) for n in names))


def compact_names(names: Sequence[str]) -> list[str]:
    """Those of the names that a compact model takes."""
    own = {*GLOBAL, *OPENING, *(f"event_1_{n}" for n in COMPACT)}
    return [n for n in names if n in own]


def aligned(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Columns in the order of a fitted model's; a missing one raises."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*keep, *names)


def without_history(df: DataFrame, history: Column, names: Sequence[str]) -> DataFrame:
    """Features that compare with a baseline are null where there is no history."""
    needs = [n for n in names if "baseline" in n or "jump" in n or n in ("robust_z", "spectral_shape_distance")]
    return df.withColumns({n: F.when(history, F.col(n)) for n in needs})


def compacted(df: DataFrame, drop: Sequence[str] = ("predictions", "folds")) -> DataFrame:
    """A result without the columns that only its making needs."""
    return df.drop(*drop)


def proposal_points(fractions: Sequence[Column], opening_s: Column, samples: Column) -> Column:
    """``array<struct<slot, row>>``: the candidates that there are, at slots from 0, and
    the opening at the last slot."""
    last = F.greatest(F.lit(1), F.floor(samples / WINDOW) - 1)
    slots = [F.when(f.isNotNull(), F.struct(F.lit(k).alias("slot"), F.rint(f * last).cast("long").alias("row"))) for k, f in enumerate(fractions)]
    return F.filter(F.array(*slots, F.struct(F.lit(len(fractions)).alias("slot"), F.rint(opening_s / ROW_S).cast("long").alias("row"))), lambda x: x.isNotNull())


def physical_windows(df: DataFrame, row: str, slot: str, samples: str, core_s: float = 0.3, opening: int = 3) -> DataFrame:
    """``start_s, end_s, is_opening`` of each point's window, which ends with the clip."""
    start = F.col(row) * ROW_S
    return df.withColumn("start_s", start).withColumn("end_s", F.least(F.col(samples) / RATE, start + core_s)).withColumn("is_opening", (F.col(slot) == opening).cast("double"))


def content_position(start_s: Column, trimmed: Column) -> Column:
    """A window's start after what was trimmed off the clip's beginning."""
    return start_s - trimmed / RATE
