"""Queries of ingest, duplicate and label operators over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.scalars import r6
from emberline.operators import labels as L
from emberline.operators import media as M
from emberline.sources.tables import clips, frames, media, table

from .common import CLIPS, FRAMES, MEDIA, Registry, r

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("""SELECT page_id, '/' || ltrim(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/') AS path FROM pages""")
def url_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages", "page_id", "url").select("page_id", M.canonical_path(F.col("url")).alias("path"))


@query("""WITH p AS (SELECT doc_id, '/' || lang || '/res/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.html' WHEN 1 THEN '.json' WHEN 2 THEN '/' ELSE '.txt' END AS path FROM documents)
  SELECT doc_id, nullif(regexp_extract(path, '^/([^/]+)/res/([0-9]+)(?:\\.(?:html|json))?/?$', 1), '') AS board, nullif(regexp_extract(path, '^/([^/]+)/res/([0-9]+)(?:\\.(?:html|json))?/?$', 2), '') AS thread FROM p""")
def thread_of_url(spark: SparkSession, sf: str) -> DataFrame:
    end = F.when(F.col("doc_id") % 4 == 0, ".html").when(F.col("doc_id") % 4 == 1, ".json").when(F.col("doc_id") % 4 == 2, "/").otherwise(".txt")
    docs = table(spark, sf, "documents", "doc_id", "lang").withColumn("path", F.concat(F.lit("/"), "lang", F.lit("/res/"), F.col("doc_id").cast("string"), end))
    board, thread = M.thread_of_url(F.col("path"))
    return docs.select("doc_id", board.alias("board"), thread.alias("thread"))


@query("""SELECT conv_id, turn, conv_id || '-' || turn || '.mp4' AS file, octet_length(encode(text))::BIGINT AS size FROM conversations""")
def thread_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations nested as snapshots, read back as files."""
    turns = table(spark, sf, "conversations", "conv_id", "turn", "text")
    file = F.struct(F.concat_ws("-", "conv_id", F.concat("turn", F.lit(".mp4"))).alias("file"), F.col("turn").alias("api_size_kib"), F.octet_length("text").cast("long").alias("size"))
    posts = turns.groupBy("conv_id").agg(F.collect_list(F.struct(F.array(file).alias("files"))).alias("posts"))
    snapshots = posts.select("conv_id", F.to_json(F.struct(F.array(F.struct("posts")).alias("threads"))).alias("payload"))
    return M.flatten_threads(snapshots).select("conv_id", F.col("api_size_kib").alias("turn"), "file", "size")


_RAW = """raw AS (SELECT doc_id, '/' || lang || CASE WHEN doc_id % 2 = 0 THEN '/src/' ELSE '/x/' END || source || '/' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.WEBM' ELSE '.mp4' END AS path,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE md5(text) END AS md5, md5(text) AS media_md5, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE n_chars END AS size_bytes, doc_id % 7 AS size FROM documents)"""


@query(f"""WITH {_RAW} SELECT path, split_part(path, '/', -1) AS file, split_part(path, '/', 2) AS board, CASE WHEN split_part(path, '/', 3) = 'src' THEN split_part(path, '/', 4) ELSE '' END AS thread,
  coalesce(nullif(md5, ''), media_md5) AS media_md5, coalesce(nullif(size_bytes, 0), nullif(size * 1024, 0), -1)::BIGINT AS source_bytes, CASE WHEN doc_id % 3 = 0 THEN 1.5::DOUBLE WHEN doc_id % 3 = 1 THEN 2.5::DOUBLE END AS source_duration_s, 'ok' AS status FROM raw WHERE NOT ends_with(path, '.jpg')""")
def media_normalize(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "lang", "source", "text", "n_chars")
    end = F.when(F.col("doc_id") % 5 == 0, ".jpg").when(F.col("doc_id") % 5 == 1, ".WEBM").otherwise(".mp4")
    none = lambda kind: F.lit(None).cast(kind)
    raw = docs.select(
        F.concat(F.lit("/"), "lang", F.when(F.col("doc_id") % 2 == 0, "/src/").otherwise("/x/"), "source", F.lit("/"), F.col("doc_id").cast("string"), end).alias("path"), none("string").alias("file"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.md5("text")).alias("md5"), F.md5("text").alias("media_md5"),
        F.when(F.col("doc_id") % 4 == 0, 0).otherwise(F.col("n_chars")).cast("long").alias("size_bytes"), none("long").alias("source_bytes"), (F.col("doc_id") % 7).alias("size"), none("long").alias("api_size_kib"),
        F.when(F.col("doc_id") % 3 == 0, 1.5).alias("duration_s"), F.when(F.col("doc_id") % 3 == 1, 2.5).otherwise(0.0).alias("duration_secs"), none("double").alias("api_duration_s"), F.lit("").alias("status"),
    )
    return M.normalize_media(raw).withColumn("source_bytes", F.coalesce("source_bytes", F.lit(-1)))


@query("""WITH raw AS (SELECT source AS key, doc_id AS ord, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS lang, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE n_chars END AS size, CASE WHEN doc_id % 97 = 5 THEN 'no-audio' ELSE 'ok' END AS status FROM documents)
  SELECT key, (SELECT lang FROM raw r WHERE r.key = raw.key AND lang <> '' ORDER BY ord LIMIT 1) AS lang, coalesce((SELECT size FROM raw r WHERE r.key = raw.key AND size IS NOT NULL ORDER BY ord LIMIT 1), -1) AS size,
  CASE WHEN bool_or(status = 'no-audio') THEN 'no-audio' ELSE 'ok' END AS status FROM raw GROUP BY key""")
def row_merge(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "lang", "source", "n_chars")
    raw = docs.select(F.col("source").alias("key"), F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 2 == 0, None).otherwise(F.col("n_chars")).alias("size"), F.when(F.col("doc_id") % 97 == 5, "no-audio").otherwise("ok").alias("status"))
    return M.merge_rows(raw, "key", "ord", ["lang", "size"]).select("key", "lang", F.coalesce("size", F.lit(-1)).alias("size"), "status")


@query("SELECT lang AS file, count(DISTINCT source) AS paths FROM documents GROUP BY lang HAVING count(DISTINCT source) > 1")
def name_collisions(spark: SparkSession, sf: str) -> DataFrame:
    return M.name_collisions(table(spark, sf, "documents", "lang", "source"), "lang", "source").withColumnRenamed("lang", "file")


@query(f"""WITH {MEDIA}, g AS (SELECT *, min(path) OVER (PARTITION BY size, digest) AS least, count(*) OVER (PARTITION BY size, digest) AS copies FROM media)
  SELECT doc_id, path, CASE WHEN least <> path THEN least END AS duplicate_of, copies FROM g""")
def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return M.exact_duplicates(media(spark, sf), "path", "size", "digest").select("doc_id", "path", "duplicate_of", "copies")


@query("""WITH p AS (SELECT doc_id, md5(text) AS digest, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS payload FROM documents),
  f AS (SELECT digest, arg_min(payload, doc_id) AS seed FROM p WHERE payload IS NOT NULL GROUP BY digest)
  SELECT doc_id, coalesce(payload, seed, -1) AS payload, payload IS NULL AND seed IS NOT NULL AS seeded FROM p LEFT JOIN f ON p.digest = f.digest""")
def seed_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "text", "n_chars").select("doc_id", F.md5("text").alias("digest"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).alias("payload"))
    return M.seed_by_digest(docs, "digest", "payload", "doc_id").select("doc_id", F.coalesce("payload", F.lit(-1)).alias("payload"), "seeded")


@query("""WITH o AS (SELECT source || '/' || doc_id AS path, CASE WHEN n_chars < 500 THEN 'failed' ELSE 'ok' END AS status FROM documents WHERE lang <> 'es'),
  n AS (SELECT source || '/' || doc_id AS path, 'ok' AS status FROM documents WHERE lang IN ('es', 'fr'))
  SELECT path, status, false AS retained_failure FROM n UNION ALL SELECT path, status, status = 'failed' FROM o WHERE path NOT IN (SELECT path FROM n)""")
def carry_anti(spark: SparkSession, sf: str) -> DataFrame:
    """An index without one language, and a new supply of two."""
    docs = table(spark, sf, "documents", "doc_id", "source", "lang", "n_chars").withColumn("path", F.concat_ws("/", "source", "doc_id"))
    old = docs.where("lang <> 'es'").select("path", F.when(F.col("n_chars") < 500, "failed").otherwise("ok").alias("status"))
    return M.upsert(old, docs.where("lang in ('es', 'fr')").select("path", F.lit("ok").alias("status")), "path")


@query("""WITH x AS (SELECT d.doc_id, source, coalesce(toxic = 1, false) AS amb, coalesce(quality = 1, false) AS pos, coalesce(quality = 0, false) AS neg FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
  y AS (SELECT *, CASE WHEN source IN ('src3', 'src4') THEN doc_id % 2 = 0 END AS listed, CASE WHEN source = 'src5' THEN doc_id % 3 = 0 END AS excluded FROM x)
  SELECT doc_id, CASE WHEN amb THEN 'unlabeled' WHEN pos AND doc_id % 11 <> 0 THEN 'positive' WHEN doc_id % 11 = 0 THEN 'visual-only' WHEN neg THEN 'negative'
    WHEN listed IS NOT NULL THEN CASE WHEN listed THEN 'negative' ELSE 'unlabeled' END WHEN excluded IS NOT NULL THEN CASE WHEN excluded THEN 'unlabeled' ELSE 'negative' END
    WHEN source = 'src6' THEN 'negative' WHEN source = 'src7' AND doc_id % 2 = 0 THEN 'positive' ELSE 'unlabeled' END AS label FROM y""")
def label_policy(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "documents", "doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    listed = F.when(F.col("source").isin("src3", "src4"), F.col("doc_id") % 2 == 0)
    excluded = F.when(F.col("source") == "src5", F.col("doc_id") % 3 == 0)
    label = L.label_policy(no(F.col("toxic") == 1), no(F.col("quality") == 1) & (F.col("doc_id") % 11 != 0), F.col("doc_id") % 11 == 0, no(F.col("quality") == 0), listed, excluded, F.col("source") == "src6", (F.col("source") == "src7") & (F.col("doc_id") % 2 == 0))
    return x.select("doc_id", label.alias("label"))


@query(f"WITH {MEDIA} SELECT label, count(*) AS files, count(DISTINCT digest) AS contents FROM media GROUP BY label")
def label_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return media(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("digest").alias("contents"))


@query(f"""WITH {MEDIA}, rules AS (SELECT * FROM (VALUES (1, '/en/src/src1', 'a'), (2, '/en/', 'b'), (3, '/fr/src/src2', 'c')) t(rule_order, prefix, kind)),
  m AS (SELECT doc_id, rule_order, kind, row_number() OVER (PARTITION BY doc_id ORDER BY rule_order) AS rn FROM media JOIN rules ON starts_with(path, prefix))
  SELECT media.doc_id, kind FROM media LEFT JOIN m ON media.doc_id = m.doc_id AND rn = 1""")
def prefix_label_join(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame([(1, "/en/src/src1", "a"), (2, "/en/", "b"), (3, "/fr/src/src2", "c")], "rule_order int, prefix string, kind string")
    return L.prefix_rules(media(spark, sf).select("doc_id", "path"), rules).select("doc_id", F.col("rule.kind").alias("kind"))


@query(f"""WITH {MEDIA} SELECT digest, min(path) AS path, min(label) AS label, count(DISTINCT label) AS labels, string_agg(DISTINCT thread, ',' ORDER BY thread) AS threads, min(thread) AS fold_thread, count(*) AS copies
  FROM media WHERE label IN ('positive', 'negative') GROUP BY digest""")
def labelled_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return L.collapse_labelled(media(spark, sf), strict=False).withColumn("threads", F.concat_ws(",", "threads"))


@query(f"""WITH {MEDIA} SELECT digest, (min(struct_pack(a := doc_id % 4 <> 0, b := path))).b AS path, coalesce(min(CASE WHEN label <> 'unlabeled' THEN label END), 'unlabeled') AS label,
  count(DISTINCT CASE WHEN label <> 'unlabeled' THEN label END) > 1 AS conflict, bool_or(doc_id % 4 = 0) AS timed, min(thread) AS fold_thread, count(DISTINCT thread) AS threads FROM media GROUP BY digest""")
def content_groups(spark: SparkSession, sf: str) -> DataFrame:
    return L.group_contents(media(spark, sf).withColumn("timed", F.col("doc_id") % 4 == 0), strict=False)


@query(f"""WITH {MEDIA}, named AS (SELECT path FROM media WHERE doc_id % 13 = 0), snap AS (SELECT path FROM media WHERE thread IN ('src1', 'src2', 'src0'))
  SELECT media.path, CASE WHEN snap.path IS NOT NULL AND named.path IS NOT NULL THEN 'positive' WHEN snap.path IS NOT NULL AND label = 'unlabeled' THEN 'negative' ELSE label END AS label
  FROM media LEFT JOIN snap ON media.path = snap.path LEFT JOIN named ON media.path = named.path""")
def review_update(spark: SparkSession, sf: str) -> DataFrame:
    m = media(spark, sf)
    return L.review_update(m.select("path", "label"), m.where(F.col("thread").isin("src0", "src1", "src2")).select("path"), m.where("doc_id % 13 = 0").select("path"))


_IV = """iv AS (SELECT clip, [struct_pack(s := min(frame) FILTER (target = 1) * 1.0::DOUBLE, e := min(frame) FILTER (target = 1) + 4.0::DOUBLE),
  struct_pack(s := (max(frame) FILTER (target = 1)) * 1.0::DOUBLE, e := (max(frame) FILTER (target = 1)) + 3.0::DOUBLE)] AS i, max(n)::DOUBLE AS duration FROM frames GROUP BY clip)"""


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Two intervals of each clip, from its first and last event."""
    f = frames(spark, sf)
    at = lambda x: F.when(F.col("target") == 1, F.col("frame").cast("double"))
    first, last = F.min(at(1)), F.max(at(1))
    one = lambda a, d: F.struct(a.alias("start_s"), (a + d).alias("end_s"))
    return f.groupBy("clip").agg(F.array(one(first, 4.0), one(last, 3.0)).alias("intervals"), F.max("n").cast("double").alias("duration"))


@query(f"""WITH {FRAMES}, {_IV} SELECT clip, coalesce(i[1].s < i[1].e AND i[2].e <= duration + 0.001 AND i[1].s >= 0 AND i[1].e <= i[2].s, false) AS valid FROM iv""")
def interval_validation(spark: SparkSession, sf: str) -> DataFrame:
    return intervals(spark, sf).select("clip", L.valid_intervals(F.col("intervals"), F.col("duration")).alias("valid"))


@query(f"""WITH {FRAMES}, {_IV}, {CLIPS}, x AS (SELECT f.clip, f.frame, f.frame * 1.0::DOUBLE AS a, f.frame + 0.3::DOUBLE AS b, label, i, duration FROM frames f JOIN iv ON f.clip = iv.clip JOIN clips ON clips.clip = f.clip)
  SELECT clip, frame, CASE WHEN label = 'negative' THEN 0 WHEN label <> 'positive' THEN -1
    WHEN len(list_filter(i, lambda v: a >= v.s + 0.05 - 1e-9 AND b <= v.e - CASE WHEN abs(v.e - duration) <= 1.0 / 16000 THEN 0.0 ELSE 0.05 END + 1e-9)) > 0 THEN 1
    WHEN len(list_filter(i, lambda v: b <= v.s - 0.05 - 6.0 + 1e-9 OR a >= v.e + 0.05 + 6.0 - 1e-9)) = len(i) THEN 0 ELSE -1 END AS target FROM x""")
def window_label(spark: SparkSession, sf: str) -> DataFrame:
    x = frames(spark, sf).select("clip", "frame").join(intervals(spark, sf), "clip").join(clips(spark, sf), "clip")
    start = F.col("frame").cast("double")
    return x.select("clip", "frame", L.window_target(F.col("label"), F.col("intervals"), start, start + 0.3, F.col("duration")).alias("target"))


@query(f"""WITH {FRAMES}, {_IV}, c AS (SELECT clip, frame * 1.0::DOUBLE + 0.2::DOUBLE AS onset FROM frames WHERE target = 0), s AS (SELECT clip, unnest(i).s AS start_s, generate_subscripts(i, 1) AS k FROM iv),
  x AS (SELECT s.clip, k, start_s, onset, abs(onset - start_s) AS d, row_number() OVER (PARTITION BY s.clip, k ORDER BY abs(onset - start_s), onset) AS rn FROM s JOIN c ON s.clip = c.clip)
  SELECT clip, k, start_s, {r('onset', 'onset')}, {r('d', 'distance')}, d <= 0.25 + 1e-9 AS hit FROM x WHERE rn = 1""")
def nearest_onset(spark: SparkSession, sf: str) -> DataFrame:
    onsets = frames(spark, sf).where("target = 0").groupBy("clip").agg(F.array_sort(F.collect_list(F.col("frame") * 1.0 + 0.2)).alias("onsets"))
    near = intervals(spark, sf).join(onsets, "clip").select("clip", F.posexplode(L.nearest_onset(F.transform("intervals", lambda i: i["start_s"]), F.col("onsets"))).alias("k", "x"))
    return near.select("clip", (F.col("k") + 1).alias("k"), F.col("x.start_s").alias("start_s"), r6(F.col("x.onset")).alias("onset"), r6(F.col("x.distance")).alias("distance"), F.col("x.hit").alias("hit"))


@query(f"""WITH {FRAMES}, {_IV}, c AS (SELECT clip, frame * 1.0::DOUBLE + 0.2::DOUBLE AS onset FROM frames WHERE target = 0), s AS (SELECT clip, unnest(i).s AS start_s, generate_subscripts(i, 1) AS k FROM iv)
  SELECT k, count(*) AS starts, count(*) FILTER (EXISTS (SELECT 1 FROM c WHERE c.clip = s.clip AND abs(onset - start_s) <= 0.25 + 1e-9)) AS covered FROM s WHERE clip IN (SELECT clip FROM c) GROUP BY k""")
def onset_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return L.onset_coverage(nearest_onset(spark, sf), "k")


@query("""WITH a AS (SELECT source, coalesce(list(DISTINCT doc_id) FILTER (doc_id % 2 = 0), []) AS x, coalesce(list(DISTINCT doc_id) FILTER (doc_id % 3 = 0), []) AS y FROM documents GROUP BY source)
  SELECT source, len(list_distinct(list_concat(x, y))) AS either, len(list_intersect(x, y)) AS both, len(list_filter(x, lambda v: NOT list_contains(y, v))) AS only_first FROM a""")
def set_ops_review(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "documents", "doc_id", "source").groupBy("source").agg(F.collect_set(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))).alias("x"), F.collect_set(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id"))).alias("y"))
    return a.select("source", F.size(F.array_union("x", "y")).alias("either"), F.size(F.array_intersect("x", "y")).alias("both"), F.size(F.array_except("x", "y")).alias("only_first"))


@query("""SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels UNION ALL (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE lang = 'en')""")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    """What only one of two sets has."""
    docs, own = table(spark, sf, "documents", "doc_id", "lang").where("lang = 'en'").select("doc_id"), table(spark, sf, "labels", "doc_id")
    return docs.exceptAll(own).distinct().union(own.exceptAll(docs).distinct())


@query("""SELECT source, CASE WHEN count(DISTINCT lang) = 1 THEN 'one' ELSE 'several' END AS langs, count(*) AS files, count(DISTINCT md5(text)) AS contents FROM documents GROUP BY source""")
def status_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents", "source", "lang", "text").groupBy("source").agg(F.when(F.count_distinct("lang") == 1, "one").otherwise("several").alias("langs"), F.count(F.lit(1)).alias("files"), F.count_distinct(F.md5("text")).alias("contents"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'timing pending' ELSE (doc_id % 9) || '–' || (doc_id % 9 + 2.5) || 's, 20–' || CASE WHEN doc_id % 2 = 0 THEN '30' ELSE '25.25' END || 's' END AS shown FROM documents""")
def interval_text(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals parsed from text and shown again."""
    docs = table(spark, sf, "documents", "doc_id")
    text = F.concat(F.lit("20:"), F.when(F.col("doc_id") % 2 == 0, "END").otherwise("25.25"), F.lit(", "), (F.col("doc_id") % 9).cast("string"), F.lit(":"), (F.col("doc_id") % 9 + 2.5).cast("string"))
    parsed = F.when(F.col("doc_id") % 5 != 0, L.parse_intervals(text, F.lit(30.0)))
    return docs.select("doc_id", L.format_intervals(parsed).alias("shown"))
