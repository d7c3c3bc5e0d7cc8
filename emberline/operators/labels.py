"""Review labels, timing intervals, window targets, and groups by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Boundary error, distance that is clear of an event, slack, nearness (seconds).
ERROR_S = 0.05
CLEAR_S = 6.0
SLACK = 1e-9
NEAR_S = 0.25


#: Prefix rules that go along with every row; more are joined.
FEW_RULES = 10_000


def label_policy(ambiguous: Column, positive: Column, visual_only: Column, negative: Column, prefix_listed: Column, provisional_excluded: Column, extra_provisional: Column, batch_excluded: Column) -> Column:
    """The review label by strict priority.  The last four are null where no such
    rule covers the path; unknown is never negative."""
    return (
        F.when(ambiguous, "unlabeled").when(positive, "positive").when(visual_only, "visual-only").when(negative, "negative")
        .when(prefix_listed.isNotNull(), F.when(prefix_listed, "negative").otherwise("unlabeled"))
        .when(provisional_excluded.isNotNull(), F.when(provisional_excluded, "unlabeled").otherwise("negative"))
        .when(F.coalesce(extra_provisional, F.lit(False)), "negative")
        .when(F.coalesce(batch_excluded, F.lit(False)), "positive")
        .otherwise("unlabeled")
    )


def prefix_rules(df: DataFrame, rules: DataFrame, path: str = "path", key: str = "path") -> DataFrame:
    """The first rule in order whose prefix begins the path, or null.

    ``rules(rule_order, prefix, ...)`` is mostly a small table kept by hand; up to
    :data:`FEW_RULES` are turned into an array on one row, so nothing is compared
    pair by pair in a join.  More are joined by equality to the paths' beginnings
    of the lengths that prefixes have.
    """
    rest = [c for c in rules.columns if c != "rule_order"]
    rule = F.struct("rule_order", *rest)
    if rules.limit(FEW_RULES + 1).count() <= FEW_RULES:
        found = rules.select(rule.alias("r")).agg(F.array_sort(F.collect_list("r")).alias("_rules"))
        fit = F.get(F.filter("_rules", lambda r: F.startswith(F.col(path), r["prefix"])), F.lit(0))
        return df.crossJoin(F.broadcast(found)).withColumn("rule", fit).drop("_rules")
    # as many lengths as the longest prefix has characters, at most
    lengths = sorted(r.n for r in rules.select(F.length("prefix").alias("n")).distinct().collect())
    each = df.select(F.col(path).alias("_path")).distinct().withColumn("_n", F.explode(F.array(*map(F.lit, lengths)))).where(F.length("_path") >= F.col("_n"))
    hit = each.select("_path", F.expr("substring(_path, 1, _n)").alias("_begin")).join(rules.select(F.col("prefix").alias("_begin"), rule.alias("r")), "_begin")
    first = hit.groupBy("_path").agg(F.min("r").alias("rule"))
    return df.join(first, F.col(path) == F.col("_path"), "left").drop("_path")


def valid_intervals(intervals: Column, duration: Column) -> Column:
    """Not empty, finite, ``0 <= start < end <= duration + 0.001``, apart (touching allowed)."""
    ordered = F.array_sort(intervals)
    fine = F.forall(ordered, lambda i: i["start_s"].isNotNull() & i["end_s"].isNotNull() & ~F.isnan(i["start_s"]) & ~F.isnan(i["end_s"]) & (i["start_s"] >= 0) & (i["start_s"] < i["end_s"]) & (i["end_s"] <= duration + 0.001))
    following = F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0)))
    apart = F.forall(F.zip_with(F.slice(ordered, F.lit(1), F.greatest(F.size(ordered) - 1, F.lit(0))), following, lambda a, b: a["end_s"] <= b["start_s"]), lambda x: x)
    return F.coalesce((F.size(intervals) > 0) & fine & apart, F.lit(False))


def parse_intervals(text: Column, duration: Column) -> Column:
    """``START:END`` items parted by commas; the end may be ``end``."""
    return F.array_sort(F.transform(F.split(F.regexp_replace(text, r"\s", ""), ","), lambda x: F.struct(
        F.split_part(x, F.lit(":"), F.lit(1)).cast("double").alias("start_s"),
        F.when(F.lower(F.split_part(x, F.lit(":"), F.lit(2))) == "end", duration).otherwise(F.split_part(x, F.lit(":"), F.lit(2)).try_cast("double")).alias("end_s"),
    )))


def format_intervals(intervals: Column) -> Column:
    """``a–bs`` joined by commas, or ``timing pending``."""
    # whole numbers lose their decimals
    show = lambda x: F.regexp_replace(F.round(x, 4).cast("string"), r"\.0$", "")
    return F.when(F.size(F.coalesce(intervals, F.array())) > 0, F.concat_ws(", ", F.transform(intervals, lambda i: F.concat(show(i["start_s"]), F.lit("–"), show(i["end_s"]), F.lit("s"))))).otherwise("timing pending")


def window_target(label: Column, intervals: Column, start: Column, end: Column, duration: Column, error: Column | float = ERROR_S) -> Column:
    """1 inside an event, 0 clear of all, -1 unknown.

    Negative clips are 0 throughout; untimed and unlabelled ones -1.  Inside
    means within an interval shrunk by the error, not at an end that is the
    clip's; clear means ``CLEAR_S`` away from every interval widened by it.
    """
    e = F.lit(error) if isinstance(error, float) else error
    inside = F.exists(intervals, lambda i: (start >= i["start_s"] + e - SLACK) & (end <= i["end_s"] - F.when(F.abs(i["end_s"] - duration) <= 1 / 16000, F.lit(0.0)).otherwise(e) + SLACK))
    clear = F.forall(intervals, lambda i: (end <= i["start_s"] - e - CLEAR_S + SLACK) | (start >= i["end_s"] + e + CLEAR_S - SLACK))
    return F.when(label == "negative", 0).when((label != "positive") | intervals.isNull(), -1).when(inside, 1).when(clear, 0).otherwise(-1)


def nearest_onset(starts: Column, candidates: Column) -> Column:
    """For each start the candidate nearest to it, the first on a tie, and whether
    it lies within 250 ms (1e-9 slack)."""
    def best(s: Column) -> Column:
        near = F.array_min(F.transform(candidates, lambda c, i: F.struct(F.abs(c - s).alias("distance"), i.alias("place"), c.alias("onset"))))
        return F.struct(s.alias("start_s"), near["onset"].alias("onset"), near["distance"].alias("distance"), (near["distance"] <= NEAR_S + SLACK).alias("hit"))

    return F.transform(starts, best)


def onset_coverage(near: DataFrame, *groups: str) -> DataFrame:
    """Starts, and those with a candidate within 250 ms, of rows with ``hit`` (null: none at
    all), by ``groups``."""
    hit = F.coalesce(F.col("hit"), F.lit(False))
    return near.groupBy(*groups).agg(F.count(F.lit(1)).alias("starts"), F.count(F.when(hit, 1)).alias("covered"))


def collapse_labelled(df: DataFrame, digest: str = "digest", label: str = "label", path: str = "path", thread: str = "thread", strict: bool = True) -> DataFrame:
    """One row per content with a positive or negative label: least path, sorted
    paths and threads, least thread as fold; two labels raise (or are flagged)."""
    out = df.where(F.col(label).isin("positive", "negative")).groupBy(digest).agg(
        F.min(path).alias("path"), F.min(label).alias("label"), F.count_distinct(label).alias("labels"),
        F.sort_array(F.collect_set(thread)).alias("threads"), F.min(thread).alias("fold_thread"), F.count(F.lit(1)).alias("copies"),
    )
    if strict:
        return out.where(F.assert_true(F.col("labels") == 1, F.concat(F.lit("conflicting labels of "), F.col(digest))).isNull()).drop("labels")
    return out


def group_contents(df: DataFrame, digest: str = "digest", label: str = "label", path: str = "path", thread: str = "thread", timed: str = "timed", intervals: str | None = None, strict: bool = True) -> DataFrame:
    """One row per content, unlabelled ones too; timed rows represent it first.

    Visual-only rows take no part; unlabelled ones don't contradict a label.  Two labels
    of one content, or timed rows whose ``intervals`` differ, fail the job; unless ``strict``,
    ``conflict`` and ``timing_conflict`` tell of them.
    """
    known = F.when(F.col(label) != "unlabeled", F.col(label))
    timing = [] if intervals is None else [(F.count_distinct(F.when(F.col(timed), F.to_json(F.struct(F.col(intervals))))) > 1).alias("timing_conflict")]
    out = df.where(F.coalesce(F.col(label) != "visual-only", F.lit(True))).groupBy(digest).agg(
        F.min_by(path, F.struct(~F.col(timed), F.col(path))).alias("path"), F.coalesce(F.min(known), F.lit("unlabeled")).alias("label"),
        (F.count_distinct(known) > 1).alias("conflict"), F.max(timed).alias("timed"), F.min(thread).alias("fold_thread"), F.count_distinct(thread).alias("threads"), *timing,
    )
    if not strict:
        return out
    for column, what in (("conflict", "labels"), *((("timing_conflict", "timings"),) if timing else ())):
        out = out.where(F.assert_true(~F.col(column), F.concat(F.lit(f"conflicting {what} of "), F.col(digest).cast("string"))).isNull()).drop(column)
    return out


def review_update(labels: DataFrame, snapshot: DataFrame, named: DataFrame) -> DataFrame:
    """Labels after a review: named files positive, the snapshot's others negative
    unless they have an explicit label; all else as it was."""
    fresh = snapshot.select("path").join(named.select("path").withColumn("_named", F.lit(True)), "path", "left").withColumn("fresh", F.when(F.col("_named"), "positive").otherwise("negative")).drop("_named")
    both = labels.join(fresh, "path", "full_outer")
    return both.select("path", F.when(F.col("fresh") == "positive", "positive").when(F.col("label").isNull() | (F.col("label") == "unlabeled"), F.coalesce("fresh", "label")).otherwise(F.col("label")).alias("label"))
