"""Queries of vector, scoring, signal, learning, augmentation and streaming operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.scalars import db_power, hellinger, logistic, r6, shares, shifted_score
from emberline.operators import augment, learn, signal, vectors
from emberline.operators.graph import checkpointed
from emberline.operators.tables import numbered
from emberline.sources.tables import clips, frames, table, windows
from emberline.streaming import files

from .common import CLIPS, FRAMES, WINDOWS, Registry, r
from .evidence import SCORED, scored

query = Registry()
QUERIES, SQL = query.queries, query.sql

_NEAR = "near AS (SELECT vec_id, label, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS a FROM embeddings)"


def _dot(x: str, y: str) -> str:
    return f"list_sum(list_transform(list_zip({x}, {y}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def _cos(x: str, y: str) -> str:
    return f"1.0::DOUBLE - greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {_dot(x, y)} / greatest(sqrt({_dot(x, x)}) * sqrt({_dot(y, y)}), 1e-12)))"


def near(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.neighbours(table(spark, sf, "embeddings"), "label", "vec_id", "embedding")


@query(f"WITH {_NEAR} SELECT vec_id, round({_cos('e', 'b')}, 5) + 0.0::DOUBLE AS from_before, round({_cos('e', 'a')}, 5) + 0.0::DOUBLE AS from_after, round({_cos('b', 'a')}, 5) + 0.0::DOUBLE AS around FROM near WHERE a IS NOT NULL AND b IS NOT NULL")
def cosine_distances(spark: SparkSession, sf: str) -> DataFrame:
    out = vectors.context_distances(near(spark, sf).where("before is not null and after is not null"), "embedding", "before", "after")
    return out.select("vec_id", *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("from_before", "from_after", "around")))


@query(f"WITH {_NEAR} SELECT vec_id, len(e) * 3 AS size, round(list_sum(list_transform(list_zip(e, b), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))), 4) AS added FROM near WHERE a IS NOT NULL AND b IS NOT NULL")
def embedding_contrast(spark: SparkSession, sf: str) -> DataFrame:
    df = near(spark, sf).where("before is not null and after is not null")
    wide = lambda c: F.transform(c, lambda x: x.cast("double"))
    c = vectors.contrast(wide("embedding"), wide("before"), wide("after"))
    added = F.aggregate(F.slice(c, F.size("embedding") + 1, F.size("embedding")), F.lit(0.0), lambda a, x: a + F.abs(x))
    return df.select("vec_id", F.size(c).cast("long").alias("size"), F.round(added, 4).alias("added"))


_GROUPS = [list(range(i, i + 9)) for i in range(0, 63, 9)]


@query("SELECT vec_id, " + ", ".join(f"round(list_sum(list_transform(embedding[{9 * i + 1}:{9 * i + 9}], lambda x: x::DOUBLE)) / 9, 6) + 0.0::DOUBLE AS g{i}" for i in range(7)) + " FROM embeddings")
def semantic_groups(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "embeddings", "vec_id", "embedding").withColumn("g", vectors.group_means(F.col("embedding"), _GROUPS))
    return df.select("vec_id", *(r6(F.col("g")[i]).alias(f"g{i}") for i in range(7)))


@query("""WITH p AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE) AS p FROM embeddings), s AS (SELECT vec_id, label, list_transform(p, lambda x: x / list_sum(p)) AS p FROM p),
  n AS (SELECT vec_id, p, lag(p) OVER (PARTITION BY label ORDER BY vec_id) AS q FROM s)
  SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(p, q), lambda z: pow(sqrt(z[1]) - sqrt(z[2]), 2))) / 2), 5) AS distance FROM n WHERE q IS NOT NULL""")
def hellinger_distance(spark: SparkSession, sf: str) -> DataFrame:
    df = near(spark, sf).where("before is not null")
    return df.select("vec_id", F.round(hellinger(shares(F.col("embedding")), shares(F.col("before"))), 5).alias("distance"))


_X = "x AS (SELECT vec_id, label, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE embedding[1]::DOUBLE END AS a, embedding[2]::DOUBLE AS b, 1.0::DOUBLE + vec_id % 3 AS w FROM embeddings)"
_FIT = f"""{_X}, m AS (SELECT quantile_cont(a, 0.5) AS ma, quantile_cont(b, 0.5) AS mb FROM x), f AS (SELECT vec_id, label, coalesce(a, ma) AS a, coalesce(b, mb) AS b, w FROM x, m),
  s AS (SELECT sum(w * a) / sum(w) AS ua, sum(w * b) / sum(w) AS ub, sum(w * a * a) / sum(w) AS qa, sum(w * b * b) / sum(w) AS qb FROM f),
  z AS (SELECT vec_id, label, greatest(-1.5, least(1.5, (a - ua) / sqrt(qa - ua * ua))) AS a, greatest(-1.5, least(1.5, (b - ub) / sqrt(qb - ub * ub))) AS b FROM f, s)"""


def scaled(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "embeddings")
    x = df.select("vec_id", "label", F.when(F.col("vec_id") % 7 != 0, F.get("embedding", F.lit(0)).cast("double")).alias("a"), F.get("embedding", F.lit(1)).cast("double").alias("b"), (1.0 + F.col("vec_id") % 3).alias("w"))
    return vectors.standardise(x, vectors.fit_scaler(x, ["a", "b"], "w"), ["a", "b"], 1.5)


@query(f"WITH {_FIT} SELECT vec_id, {r('a', 'a')}, {r('b', 'b')} FROM z")
def standardize_impute_clip(spark: SparkSession, sf: str) -> DataFrame:
    return scaled(spark, sf).select("vec_id", r6("a").alias("a"), r6("b").alias("b"))


@query(f"WITH {_FIT} SELECT label, round(sum(p * p) / greatest(sum(p), 1e-12), 6) AS score FROM (SELECT label, 1 / (1 + exp(-(0.7::DOUBLE * a - 1.3::DOUBLE * b + 0.25::DOUBLE))) AS p FROM z) GROUP BY label")
def linear_score(spark: SparkSession, sf: str) -> DataFrame:
    from emberline.operators.pooling import linear_softmax

    p = logistic(vectors.linear_margin(["a", "b"], [0.7, -1.3], 0.25))
    return scaled(spark, sf).withColumn("p", p).groupBy("label").agg(F.round(linear_softmax(F.col("p")), 6).alias("score"))


_TREE = [
    {"leaf": False, "feature": "a", "threshold": 0.1, "left": 1, "right": 2, "value": None}, {"leaf": True, "value": -0.5, "feature": None, "threshold": None, "left": None, "right": None},
    {"leaf": False, "feature": "b", "threshold": -0.2, "left": 3, "right": 4, "value": None}, {"leaf": True, "value": 0.25, "feature": None, "threshold": None, "left": None, "right": None}, {"leaf": True, "value": 0.75, "feature": None, "threshold": None, "left": None, "right": None},
]


@query(f"WITH {_FIT} SELECT vec_id, 0.1::DOUBLE + CASE WHEN a <= 0.1 THEN -0.5::DOUBLE WHEN b <= -0.2 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END AS margin FROM z")
def tree_score(spark: SparkSession, sf: str) -> DataFrame:
    return scaled(spark, sf).select("vec_id", vectors.forest_margin([_TREE], 0.1).alias("margin"))


@query()
def pca_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings on their leading components, from sums of second moments."""
    df = table(spark, sf, "embeddings", "vec_id", "embedding").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    mean, lead, _ = vectors.fit_components(df, "v", 4)
    return df.select("vec_id", F.transform(vectors.project(F.col("v"), mean, lead), lambda x: F.round(x, 6)).alias("projected"))


@query()
def iir_level(spark: SparkSession, sf: str) -> DataFrame:
    """Levels of the weighted signal; a filter carries state from sample to sample."""
    df = frames(spark, sf).select("clip", "frame", (F.col("value") / 500).alias("value"))
    return signal.clip_kernel(df, signal.filtered_levels, "block long, level double").withColumn("level", F.round("level", 6))


@query()
def frame_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    df = frames(spark, sf).select("clip", "frame", (F.col("value") / 500).alias("value"))
    out = signal.clip_kernel(df, signal.spectral_summary, "block long, centroid double, flatness double, flux double")
    return out.select("clip", "block", *(F.round(c, 6).alias(c) for c in ("centroid", "flatness", "flux")))


@query(f"WITH {SCORED}, t AS (SELECT max(before) AS cut FROM scored WHERE label = 'negative') SELECT clip, round(1 / (1 + exp(-(ln(s / (1 - s)) + ln(0.8::DOUBLE / (1 - 0.8::DOUBLE)) - ln(cut / (1 - cut))))), 6) AS shown FROM (SELECT clip, greatest(1e-12, least(1 - 1e-12, before)) AS s FROM scored), t")
def shifted_scores(spark: SparkSession, sf: str) -> DataFrame:
    df = scored(spark, sf)
    cut = df.where("label = 'negative'").agg(F.max("before").alias("cut"))
    return df.crossJoin(F.broadcast(cut)).select("clip", F.round(shifted_score(F.col("before"), F.col("cut")), 6).alias("shown"))


def bags(spark: SparkSession, sf: str) -> DataFrame:
    """Windows with three features, bags labelled by their clips."""
    w = windows(spark, sf).join(clips(spark, sf).where("label <> 'unlabeled'"), "clip")
    return w.select("clip", "frame", "thread", "target", "p", (F.col("label") == "positive").alias("positive"), (F.col("jump") / 10).alias("x1"), (F.col("level") / 30).alias("x2"), (F.col("jump") * F.col("jump") / 100).alias("x3"))


@query()
def mil_linear_softmax_fit(spark: SparkSession, sf: str) -> DataFrame:
    """One fit per held-out thread, each a task of its own."""
    df = bags(spark, sf)
    held = df.withColumn("fold", F.explode(F.array(*map(F.lit, range(3))))).where(F.col("thread") % 3 != F.col("fold"))
    return learn.fit_by_fold(held, "fold", ["x1", "x2", "x3"]).withColumn("weight", F.round("weight", 4))


@query(f"""WITH {WINDOWS}, {CLIPS}, b AS (SELECT w.clip, frame, target, p, label = 'positive' AS positive FROM windows w JOIN clips c ON w.clip = c.clip WHERE label <> 'unlabeled'),
  k AS (SELECT *, count(*) OVER (PARTITION BY clip) AS n, row_number() OVER (PARTITION BY clip ORDER BY p DESC, frame) AS rk, row_number() OVER (PARTITION BY clip ORDER BY CASE WHEN target = 0 THEN 1 ELSE 0 END, p DESC, frame) AS bk FROM b),
  y AS (SELECT *, CASE WHEN NOT positive THEN 0 WHEN target = 1 OR (bk = 1 AND target <> 0) THEN 1 WHEN target = 0 THEN 0 ELSE -1 END AS y FROM k)
  SELECT clip, frame, y, round((CASE WHEN NOT positive THEN 0.25::DOUBLE / n + CASE WHEN rk <= 3 THEN 0.75::DOUBLE / least(n, 3) ELSE 0 END WHEN y = 1 THEN 1.0::DOUBLE / sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY clip)
    WHEN y = 0 THEN 0.1::DOUBLE / sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY clip) ELSE 0 END) * (1.0::DOUBLE + clip % 3), 6) + 0.0::DOUBLE AS weight FROM y""")
def hard_negative_supervision(spark: SparkSession, sf: str) -> DataFrame:
    return learn.instance_supervision(bags(spark, sf).withColumn("own", 1.0 + F.col("clip") % 3), bag_weight="own").select("clip", "frame", "y", r6("weight").alias("weight"))


_GRID = [0.5 + 0.05 * i for i in range(10)]
_CAND = "cand AS (SELECT 'base' AS c, 0 AS o, clip, label = 'positive' AS y, top AS s FROM scored WHERE label <> 'unlabeled' UNION ALL SELECT 'pooled', 1, clip, label = 'positive', after FROM scored WHERE label <> 'unlabeled' UNION ALL SELECT 'soft', 2, clip, label = 'positive', CASE WHEN label = 'positive' THEN top ELSE before END FROM scored WHERE label <> 'unlabeled')"


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    s = checkpointed(scored(spark, sf).where("label <> 'unlabeled'")).withColumn("positive", F.col("label") == "positive")
    each = [("base", F.col("top")), ("pooled", F.col("after")), ("soft", F.when(F.col("positive"), F.col("top")).otherwise(F.col("before")))]
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("candidate"), F.lit(i).alias("candidate_order"), c.alias("score")) for i, (n, c) in enumerate(each))))
    return s.select("clip", "positive", rows.alias("r")).select("clip", "positive", "r.*")


@query(f"""WITH {SCORED}, {_CAND}, b AS (SELECT clip, s >= 0.8 AS caught, y FROM cand WHERE c = 'base'), fp AS (SELECT sum(CASE WHEN caught AND NOT y THEN 1 ELSE 0 END) AS fp FROM b),
  t AS (SELECT c, o, t, sum(CASE WHEN cand.y AND s >= t THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN NOT cand.y AND s >= t THEN 1 ELSE 0 END) AS f, sum(CASE WHEN cand.y AND caught AND s < t THEN 1 ELSE 0 END) AS lost
    FROM cand JOIN b ON cand.clip = b.clip, (SELECT unnest([{', '.join(f'{g!r}::DOUBLE' for g in _GRID)}]) AS t) GROUP BY 1, 2, 3),
  ok AS (SELECT c AS candidate, t AS threshold, 0 AS z, f, tp, o FROM t, fp WHERE lost = 0 AND f < fp AND f <= 0.8 * fp UNION ALL SELECT 'base', 0.8::DOUBLE, 1, 0, 0, 0)
  SELECT candidate, round(threshold, 6) AS threshold FROM ok ORDER BY z, f, tp DESC, o, abs(threshold - 0.8), threshold, candidate LIMIT 1""")
def policy_selection(spark: SparkSession, sf: str) -> DataFrame:
    return learn.select_policy(candidates(spark, sf), "base", _GRID).select("candidate", F.round("threshold", 6).alias("threshold"))


@query(f"""WITH {SCORED}, {_CAND}, b AS (SELECT clip, s AS own FROM cand WHERE c = 'base'), k AS (SELECT c, o, sum(CASE WHEN y AND ((own >= 0.8 AND s < 0.8) OR (own >= 0.6 AND s < 0.6)) THEN 1 ELSE 0 END) AS lost,
  sum(CASE WHEN NOT y AND s >= 0.8 THEN 1 ELSE 0 END) AS red, sum(CASE WHEN NOT y AND s >= 0.6 AND s < 0.8 THEN 1 ELSE 0 END) AS yellow FROM cand JOIN b ON cand.clip = b.clip GROUP BY c, o)
  SELECT c AS candidate, red::BIGINT AS red, yellow::BIGINT AS yellow FROM k WHERE lost = 0 ORDER BY red, yellow, o LIMIT 1""")
def robust_selection(spark: SparkSession, sf: str) -> DataFrame:
    return learn.select_robust(candidates(spark, sf).withColumn("view", F.lit("original")), "base").select("candidate", "red", "yellow")


@query(f"""WITH {CLIPS}, back AS (SELECT row_number() OVER (ORDER BY clip) - 1 AS number, clip AS background FROM clips WHERE label = 'negative'), many AS (SELECT count(*) AS many FROM back),
  plan AS (SELECT clip, label, 'real' AS kind, 'base' AS split, 0 AS variant, 'original' AS profile FROM clips
    UNION ALL SELECT clip, label, 'real', 'train', v, 'train-' || lpad(((v - 1) % 12)::VARCHAR, 2, '0') FROM clips, range(1, 13) g(v) WHERE label <> 'unlabeled' AND v <= CASE WHEN label = 'positive' THEN 12 ELSE 2 END
    UNION ALL SELECT clip, label, 'real', 'evaluation', v, 'evaluation-' || substr('abc', v::INT, 1) FROM clips, range(1, 4) g(v) WHERE label <> 'unlabeled' UNION ALL SELECT clip, label, 'synthetic', 'train', v, 'mix' FROM clips, range(1, 5) g(v) WHERE label = 'positive')
  SELECT clip || ':' || kind || ':' || split || ':' || variant AS key, profile, CASE WHEN profile = 'original' THEN 0.0::DOUBLE ELSE round(-12.0::DOUBLE + 18.0::DOUBLE * (('0x' || substr(md5('gain1:' || clip || ':' || kind || ':' || split || ':' || variant), 1, 8))::BIGINT / 4294967296.0::DOUBLE), 3) END + 0.0::DOUBLE AS gain_db,
    coalesce(background, -1) AS background FROM plan, many LEFT JOIN back ON kind = 'synthetic' AND number = ('0x' || substr(md5('1:' || clip || ':' || variant), 1, 8))::BIGINT % many""")
def augmentation_plan(spark: SparkSession, sf: str) -> DataFrame:
    c = clips(spark, sf)
    back = numbered(c.where("label = 'negative'").select(F.col("clip").alias("background")), "background")
    return augment.plan(c, back).select("key", "profile", (F.col("gain_db") + F.lit(0.0)).alias("gain_db"), F.coalesce("background", F.lit(-1)).alias("background"))


def _scratch(spark: SparkSession) -> str:
    """A fresh folder beside the checkpoints, which driver and executors share."""
    checkpointed(spark.range(1))
    return f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


@query("SELECT event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def streaming_available_now(spark: SparkSession, sf: str) -> DataFrame:
    """All landed files consumed by a stream that then ends."""
    to = _scratch(spark)
    source = files.landed(spark, f"{sf}/events.parquet*", table(spark, sf, "events").schema)
    out = files.drain_totals(source, ["event_type"], {"events": F.count(F.lit(1)), "total": F.sum("value")}, f"{to}/out", f"{to}/state")
    return out.select("event_type", "events", F.round("total", 2).alias("total"))


@query("SELECT DISTINCT event_id FROM events")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    to = _scratch(spark)
    source = files.landed(spark, f"{sf}/events.parquet*", table(spark, sf, "events").schema).select("event_id", "ts")
    return files.drain(files.without_repeats(source, "event_id"), f"{to}/out", f"{to}/state").select("event_id")


@query(f"WITH {FRAMES}, e AS (SELECT clip, avg(pow(10, level / 10)) AS power, max(level) AS top FROM frames GROUP BY clip) SELECT clip, round(10 * log10(power), 6) AS mean_db, round(top, 6) AS top FROM e")
def mean_levels(spark: SparkSession, sf: str) -> DataFrame:
    e = frames(spark, sf).groupBy("clip").agg(F.avg(db_power(F.col("level"))).alias("power"), F.max("level").alias("top"))
    return e.select("clip", F.round(10 * F.log10("power"), 6).alias("mean_db"), F.round("top", 6).alias("top"))


def numbered_embeddings(spark: SparkSession, sf: str, entries: int) -> DataFrame:
    """``vec_id, positive, e0 ..``: labels under 5 are positive."""
    df = table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    return df.select("vec_id", (F.col("label") < 5).alias("positive"), *(F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(entries)))


@query()
def extra_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings scored by extremely randomised trees grown over all of them."""
    from emberline.operators import forest

    df = numbered_embeddings(spark, sf, 64)
    model = forest.extra_trees(df, [f"e{k}" for k in range(64)], "positive", trees=20, depth=6, seed=7)
    return forest.forest_scores(df, model, ["vec_id"]).select("vec_id", F.round("score", 6).alias("score"))


@query()
def kernel_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings scored by a logistic model over random Fourier features of their first eight entries."""
    from emberline.operators import kernel

    df = numbered_embeddings(spark, sf, 8)
    model = kernel.fit_kernel(df, [f"e{k}" for k in range(8)], "positive", 0.1, 64, seed=7)
    return df.select("vec_id", F.round(model.score(), 6).alias("score"))


@query()
def two_part_transform(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings' first four entries standardised, beside three components of whole embeddings."""
    from emberline.operators import transform

    df = table(spark, sf, "embeddings", "vec_id", "embedding").select("vec_id", "embedding", *(F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(4)))
    model = transform.fit_two_part(df, "vec_id", [f"e{k}" for k in range(4)], "embedding", 3)
    out = transform.two_part(df, model, "embedding", ["vec_id"])
    return out.select("vec_id", *(F.round(n, 6).alias(n) for n in model.names()))
