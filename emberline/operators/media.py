"""Ingest: nested threads, normalised media rows, exact duplicates, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File endings that count as video, and the snapshot schema.
VIDEO = (".mp4", ".webm", ".m4v", ".mov", ".ogv")
FILE = "path string, file string, md5 string, media_md5 string, size long, size_bytes long, source_bytes long, api_size_kib long, duration_s double, duration_secs double, api_duration_s double, status string"
THREADS = f"struct<threads:array<struct<posts:array<struct<files:array<struct<{', '.join(':'.join(x.split()) for x in FILE.split(', '))}>>>>>>>"


def or_else(*columns: Column) -> Column:
    """The first that is neither null, zero nor empty."""
    return F.coalesce(*(F.when(~F.coalesce(c.cast("string"), F.lit("")).isin("", "0", "0.0"), c) for c in columns))


def flatten_threads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per file of a JSON snapshot: threads of posts of files, or a bare list
    of files.  Null lists are empty; anything else raises."""
    text = F.ltrim(F.col(payload))
    kind = F.assert_true(F.coalesce(text.startswith("[") | (text.startswith("{") & F.get_json_object(payload, "$.threads").isNotNull()), F.lit(False)), F.lit("a snapshot is a list of files or has threads"))
    keep = [c for c in df.columns if c != payload]
    nested = F.from_json(payload, THREADS, {"mode": "FAILFAST"})
    bare = F.from_json(payload, f"array<struct<{', '.join(':'.join(x.split()) for x in FILE.split(', '))}>>", {"mode": "FAILFAST"})
    posts = F.flatten(F.transform(nested["threads"], lambda t: F.coalesce(t["posts"], F.array())))
    files = F.when(text.startswith("["), bare).otherwise(F.flatten(F.transform(posts, lambda p: F.coalesce(p["files"], F.array()))))
    return df.where(kind.isNull()).select(*keep, F.posexplode(files).alias("ordinal", "f")).select(*keep, "ordinal", "f.*")


def canonical_path(url: Column) -> Column:
    """Scheme, host, query and fragment off, one slash in front."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    return F.concat(F.lit("/"), F.regexp_replace(bare, "^/+", ""))


def thread_of_url(path: Column) -> tuple[Column, Column]:
    """Board and thread number of a thread page's path; null for other paths."""
    pattern = r"^/([^/]+)/res/([0-9]+)(?:\.(?:html|json))?/?$"
    return tuple(F.nullif(F.regexp_extract(path, pattern, k), F.lit("")) for k in (1, 2))


def thread_key(path: Column, other: str = "unknown") -> Column:
    """The thread of a stored file, ``/board/src/thread/file``; else ``other``."""
    part = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.when((F.get(part, F.lit(1)) == "src") & (F.size(part) >= 4), F.get(part, F.lit(2))).otherwise(other)


def is_video(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0)).isin(*VIDEO)


def normalize_media(df: DataFrame) -> DataFrame:
    """Video rows with one name for each fact; zero and empty count as missing."""
    path = canonical_path(F.col("path"))
    part = F.split(F.regexp_replace(path, "^/", ""), "/")
    return df.where(is_video(F.col("path"))).select(
        path.alias("path"), or_else(F.col("file"), F.element_at(part, -1)).alias("file"), F.get(part, F.lit(0)).alias("board"), thread_key(path, "").alias("thread"),
        or_else(F.col("md5"), F.col("media_md5")).alias("media_md5"),
        or_else(F.col("size_bytes"), F.col("source_bytes"), F.col("size") * 1024, F.col("api_size_kib") * 1024).alias("source_bytes"),
        or_else(F.col("duration_s"), F.col("duration_secs"), F.col("api_duration_s")).alias("source_duration_s"),
        F.coalesce(or_else(F.col("status")), F.lit("ok")).alias("status"),
    )


def merge_rows(df: DataFrame, key: str, order: str, fields: list[str], status: str | None = "status") -> DataFrame:
    """One row per key: each field's first non-empty value in order; any
    ``no-audio`` decides the status."""
    def first(c: str) -> Column:
        empty = F.col(c).isNull() | (F.col(c).cast("string") == "") | (F.col(c).cast("string") == "unlabeled")
        return F.min_by(F.when(~empty, F.col(c)), F.when(~empty, F.col(order))).alias(c)

    out = df.groupBy(key).agg(*(first(c) for c in fields), *([F.max(F.when(F.col(status) == "no-audio", 1).otherwise(0)).alias("_silent"), first(status)] if status else []))
    return out.withColumn(status, F.when(F.col("_silent") == 1, "no-audio").otherwise(F.col(status))).drop("_silent") if status else out


def name_collisions(df: DataFrame, file: str = "file", path: str = "path") -> DataFrame:
    """Files that are named under several paths, an error of the input."""
    return df.groupBy(file).agg(F.count_distinct(path).alias("paths")).where("paths > 1")


def exact_duplicates(df: DataFrame, path: str, size: str, digest: str) -> DataFrame:
    """``duplicate_of``: the least path with the same bytes, null on that one itself.

    The least paths are added up before they are joined back, so one content
    that fills a third of the table is no burden on a single task.
    """
    least = df.groupBy(size, digest).agg(F.min(path).alias("_least"), F.count(F.lit(1)).alias("copies"))
    return df.join(least, [size, digest]).withColumn("duplicate_of", F.when(F.col("_least") != F.col(path), F.col("_least"))).drop("_least")


def seed_by_digest(df: DataFrame, digest: str, payload: str, order: str) -> DataFrame:
    """Rows without a payload take that of the first row with their digest."""
    first = df.where(F.col(payload).isNotNull() & F.col(digest).isNotNull()).groupBy(digest).agg(F.min_by(payload, order).alias("_seed"))
    return df.join(first, digest, "left").withColumn("seeded", F.col(payload).isNull() & F.col("_seed").isNotNull()).withColumn(payload, F.coalesce(payload, "_seed")).drop("_seed")


def upsert(old: DataFrame, new: DataFrame, key: str, retry_failed: bool = False) -> DataFrame:
    """New rows, and old ones that are not supplied again; old failures are flagged
    as retained unless they are to be retried."""
    carried = old.join(new.select(key), key, "left_anti").withColumn("retained_failure", (F.col("status") == "failed") & F.lit(not retry_failed))
    return new.withColumn("retained_failure", F.lit(False)).unionByName(carried)
