"""Queries of checked joins, projections by name, and points of feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.scalars import r6
from emberline.operators import frames as W
from emberline.operators import tables as T
from emberline.sources.tables import frames, media, table

from .common import FRAMES, MEDIA, Registry, r

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def checked_join(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders", "o_orderkey", "o_custkey").withColumnRenamed("o_custkey", "c_custkey")
    named = T.checked_join(orders, table(spark, sf, "customer", "c_custkey", "c_mktsegment", "c_nationkey").withColumnRenamed("c_nationkey", "n_nationkey"), ["c_custkey"])
    return T.appended(named, table(spark, sf, "nation", "n_nationkey", "n_name"), ["n_nationkey"], ["n_name"]).select("o_orderkey", "c_mktsegment", "n_name")


@query("""SELECT l.doc_id, coalesce(d.lang, 'unknown') AS lang, coalesce(c.role, 'whole') AS role FROM labels l LEFT JOIN (SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 0) d ON l.doc_id = d.doc_id
  LEFT JOIN (SELECT DISTINCT conv_id, role FROM conversations WHERE turn = 0) c ON l.doc_id = c.conv_id WHERE quality = 1""")
def with_defaults(spark: SparkSession, sf: str) -> DataFrame:
    positives = table(spark, sf, "labels", "doc_id", "quality").where("quality = 1").select("doc_id")
    index = table(spark, sf, "documents", "doc_id", "lang").where("doc_id % 3 <> 0")
    timings = table(spark, sf, "conversations", "conv_id", "turn", "role").where("turn = 0").select(F.col("conv_id").alias("doc_id"), "role").distinct()
    return T.with_defaults(positives, index, timings, "doc_id", {"lang": "unknown", "role": "whole"})


_ZIP = "row_number() OVER (PARTITION BY user_id ORDER BY {0}) AS place"


@query(f"""WITH a AS (SELECT user_id, value, {_ZIP.format('event_id')} FROM events), b AS (SELECT user_id, event_type, {_ZIP.format('event_id')} FROM events)
  SELECT a.user_id, a.place, value, event_type FROM a JOIN b ON a.user_id = b.user_id AND a.place = b.place""")
def strict_zip(spark: SparkSession, sf: str) -> DataFrame:
    both = T.strict_zip(table(spark, sf, "events", "user_id", "event_id", "value"), table(spark, sf, "events", "user_id", "event_id", "event_type"), "user_id", "event_id")
    return both.select("user_id", F.col("place").cast("long").alias("place"), "value", "event_type")


@query("SELECT a.doc_id AS query, b.doc_id AS reference FROM documents a JOIN documents b ON a.source = b.source AND b.doc_id = a.doc_id + 20 WHERE sha256(a.text) <> sha256(b.text)")
def other_contents(spark: SparkSession, sf: str) -> DataFrame:
    """Matches of contents with others only."""
    docs = table(spark, sf, "documents", "doc_id", "source", "text").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    later = docs.select((F.col("doc_id") - 20).alias("doc_id"), "source", F.col("doc_id").alias("reference"), F.col("digest").alias("other"))
    return docs.join(later, ["doc_id", "source"]).where("digest <> other").select(F.col("doc_id").alias("query"), "reference")


@query(f"WITH {MEDIA} SELECT path, size, digest FROM media WHERE file = '17.mp4'")
def one_media(spark: SparkSession, sf: str) -> DataFrame:
    return T.one_media(media(spark, sf), "17.mp4").select("path", "size", "digest")


@query("""WITH u AS (SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2)
  SELECT lang, count(*) AS sources, arg_min(doc_id, source) AS first, coalesce(max(CASE WHEN source = 'src7' THEN doc_id END), -1) AS seven FROM u GROUP BY lang""")
def view_map(spark: SparkSession, sf: str) -> DataFrame:
    one = table(spark, sf, "documents", "doc_id", "lang", "source").groupBy("lang", "source").agg(F.min("doc_id").alias("doc_id"))
    out = T.view_map(one, "lang", "source", "doc_id")
    return out.select("lang", F.size("records").cast("long").alias("sources"), F.map_values("records")[0].alias("first"), F.coalesce(F.try_element_at("records", F.lit("src7")), F.lit(-1)).alias("seven"))


@query(f"""WITH m AS (SELECT *, sum(l_tax * l_discount) OVER (PARTITION BY l_partkey) / greatest(sum(l_tax) OVER (PARTITION BY l_partkey), 1e-20) AS mean FROM lineitem)
  SELECT l_partkey, {r('max(mean)', 'mean')}, {r('sum(l_tax * pow(l_discount - mean, 2))', 'spread')} FROM m GROUP BY l_partkey""")
def consistency(spark: SparkSession, sf: str) -> DataFrame:
    out = T.consistency(table(spark, sf, "lineitem", "l_partkey", "l_tax", "l_discount"), "l_partkey", "l_tax", "l_discount")
    return out.select("l_partkey", r6("mean").alias("mean"), r6("spread").alias("spread"))


@query(f"SELECT {r('max(abs(l_discount - round(l_discount, 1)))', 'worst')}, max(abs(l_discount - round(l_discount, 1))) <= 0.04 AS equal FROM lineitem")
def parity(spark: SparkSession, sf: str) -> DataFrame:
    out = T.parity(table(spark, sf, "lineitem", "l_discount").withColumn("other", F.round("l_discount", 1)), "l_discount", "other", 0.04)
    return out.select(r6("worst").alias("worst"), "equal")


@query("""SELECT l_orderkey AS query, l_linenumber AS reference, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R' DESC, l_discount DESC, l_quantity DESC, l_linenumber) AS place FROM lineitem""")
def ranked_matches(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_discount", "l_quantity")
    found = lines.select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("reference"), (F.col("l_returnflag") == "R").alias("confirmed"), F.col("l_discount").alias("fraction"), F.col("l_quantity").alias("anchors"))
    return T.ranked_matches(found).select("query", "reference", F.col("place").cast("long").alias("place"))


@query(f"WITH {MEDIA} SELECT path, file FROM media ORDER BY path LIMIT 25")
def first_by_path(spark: SparkSession, sf: str) -> DataFrame:
    """The feature's own limit option."""
    return T.first_by_path(media(spark, sf).select("path", "file"), 25)


_NAMES = ["click", "none", "view", "error"]


@query("WITH m AS (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY 1, 2) SELECT user_id, " + ", ".join(f"coalesce(max(CASE WHEN event_type = '{n}' THEN v END), -1.0) AS {n}_value" for n in _NAMES) + " FROM m GROUP BY user_id")
def project_names(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of a map by name; what is missing shows as -1 here."""
    best = table(spark, sf, "events", "user_id", "event_type", "value").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    held = best.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m")).withColumn("p", T.project_names(F.col("m"), _NAMES))
    return T.aligned(held.select("user_id", *(F.nanvl(F.col("p")[k], F.lit(-1.0)).alias(f"{n}_value") for k, n in enumerate(_NAMES))), [f"{n}_value" for n in reversed(_NAMES)], ["user_id"])


@query(f"""WITH {FRAMES}, h AS (SELECT *, quantile_cont(level, 0.5) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN 12 PRECEDING AND 3 PRECEDING) AS b FROM frames)
  SELECT clip, frame, CASE WHEN frame >= 3 THEN round(b, 6) + 0.0::DOUBLE END AS baseline_10, CASE WHEN frame >= 3 THEN round(level - b, 6) + 0.0::DOUBLE END AS jump_10, {r('level', 'level')} FROM h""")
def without_history(spark: SparkSession, sf: str) -> DataFrame:
    out = W.horizons(frames(spark, sf), "level", (10,))
    out = T.without_history(out, F.col("frame") >= 3, ["baseline_10", "jump_10", "level"])
    return T.compacted(out, ("mad_10",)).select("clip", "frame", r6("baseline_10").alias("baseline_10"), r6("jump_10").alias("jump_10"), r6("level").alias("level"))


@query(f"""WITH d AS (SELECT doc_id, n_chars * 40 AS samples, CASE WHEN doc_id % 4 <> 1 THEN (doc_id % 80) / 79.0::DOUBLE END AS a, CASE WHEN doc_id % 4 > 1 THEN 0.5::DOUBLE END AS b, (doc_id % 20) * 0.05::DOUBLE AS opening, doc_id % 160 * 16 AS trimmed FROM documents),
  p AS (SELECT *, 0 AS slot, round_even(a * greatest(1, samples // 800 - 1), 0)::BIGINT AS spot FROM d WHERE a IS NOT NULL UNION ALL SELECT *, 1, round_even(b * greatest(1, samples // 800 - 1), 0)::BIGINT FROM d WHERE b IS NOT NULL UNION ALL SELECT *, 2, round_even(opening / 0.05, 0)::BIGINT FROM d)
  SELECT doc_id, slot, {r('spot * 0.05', 'start_s')}, {r('least(samples / 16000.0, spot * 0.05 + 0.3)', 'end_s')}, CASE WHEN slot = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_opening, {r('spot * 0.05 - trimmed / 16000.0', 'position_s')} FROM p""")
def proposal_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Points of two candidates and the opening, and their windows."""
    d = F.col("doc_id")
    docs = table(spark, sf, "documents", "doc_id", "n_chars").withColumn("samples", F.col("n_chars") * 40)
    at = T.proposal_points([F.when(d % 4 != 1, (d % 80) / 79.0), F.when(d % 4 > 1, 0.5)], (d % 20) * 0.05, F.col("samples"))
    each = docs.withColumn("at", F.explode(at)).select("doc_id", "samples", "at.slot", "at.row")
    out = T.physical_windows(each, "row", "slot", "samples", opening=2).withColumn("position_s", T.content_position(F.col("start_s"), d % 160 * 16))
    return out.select("doc_id", "slot", *(r6(c).alias(c) for c in ("start_s", "end_s")), "is_opening", r6("position_s").alias("position_s"))
