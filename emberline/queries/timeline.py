"""Queries of frame, selection and pooling operators over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.scalars import r6, risk_tier
from emberline.operators import frames as W
from emberline.operators import pooling as A
from emberline.operators import selection as T
from emberline.sources.tables import frames, windows

from .common import BASED, FRAMES, TIER, WINDOWS, Registry, r

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query(f"WITH {WINDOWS}, pooled AS (SELECT clip, sum(p * p) / greatest(sum(p), 1e-12) AS score FROM windows GROUP BY clip) SELECT clip, {r('score', 'score')}, {TIER.format('score')} AS tier FROM pooled")
def risk_tier_by_clip(spark: SparkSession, sf: str) -> DataFrame:
    pooled = windows(spark, sf).groupBy("clip").agg(A.linear_softmax(F.col("p")).alias("score"))
    return pooled.select("clip", r6("score").alias("score"), risk_tier(F.col("score")).alias("tier"))


@query(f"WITH {WINDOWS}, pooled AS (SELECT clip, sum(pow(p, 8)) / sum(pow(p, 7)) AS score FROM windows GROUP BY clip), tiered AS (SELECT {TIER.format('score')} AS tier FROM pooled) SELECT tier, count(*) AS clips FROM tiered GROUP BY tier")
def tier_histogram(spark: SparkSession, sf: str) -> DataFrame:
    pooled = windows(spark, sf).groupBy("clip").agg(A.power_pool(F.col("p"), 8).alias("score"))
    return pooled.groupBy(risk_tier(F.col("score")).alias("tier")).agg(F.count(F.lit(1)).alias("clips"))


@query(f"""WITH {FRAMES}, blocks AS (SELECT clip, frame // 8 AS block, count(*) AS k, avg((value / 500) * (value / 500)) AS power, max(abs(value / 500)) AS peak,
  avg(CASE WHEN abs(value / 500) >= pow(10, -1.0 / 20) THEN 1.0::DOUBLE ELSE 0 END) AS clipped FROM frames GROUP BY 1, 2)
  SELECT clip, block, {r('greatest(-90.0, -0.691 + 10 * log10(greatest(power, 1e-9)))', 'level')}, {r('peak', 'peak')}, {r('clipped', 'clipped')} FROM blocks WHERE k = 8""")
def level_timeline(spark: SparkSession, sf: str) -> DataFrame:
    out = W.tumbling_levels(frames(spark, sf).withColumn("x", F.col("value") / 500), "x", 8)
    return out.select("clip", "block", r6("level").alias("level"), r6("peak").alias("peak"), r6("clipped").alias("clipped"))


@query(f"WITH {BASED} SELECT clip, frame, {r('baseline', 'baseline')}, {r('jump', 'jump')} FROM jumped WHERE frame >= 22 AND frame < n - 5")
def trailing_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return W.trailing_baseline(frames(spark, sf)).where(W.scored()).select("clip", "frame", r6("baseline").alias("baseline"), r6("jump").alias("jump"))


MAD = BASED + """, held AS (SELECT *, list(level) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN 60 PRECEDING AND 3 PRECEDING) AS l FROM jumped),
  maddened AS (SELECT * EXCLUDE (l), list_aggregate(list_transform(l, lambda x: abs(x - baseline)), 'quantile_cont', 0.5) AS mad FROM held)"""


@query(f"WITH {MAD} SELECT clip, frame, {r('mad', 'mad')} FROM maddened WHERE frame >= 22 AND frame < n - 5")
def trailing_mad(spark: SparkSession, sf: str) -> DataFrame:
    return W.trailing_mad(W.trailing_baseline(frames(spark, sf))).where(W.scored()).select("clip", "frame", r6("mad").alias("mad"))


_H = ", ".join(f"coalesce(quantile_cont(level, 0.5) OVER h{h}, -90.0) AS b{h}, list(level) OVER h{h} AS l{h}" for h in (10, 20, 60, 120))
_HW = ", ".join(f"h{h} AS (PARTITION BY clip ORDER BY frame ROWS BETWEEN {h + 2} PRECEDING AND 3 PRECEDING)" for h in (10, 20, 60, 120))


@query(f"WITH {FRAMES}, h AS (SELECT *, quantile_cont(level, 0.25) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS event, {_H} FROM frames WINDOW {_HW}) SELECT clip, frame, " + ", ".join(
    f"{r(f'b{h}', f'baseline_{h}')}, round(coalesce(list_aggregate(list_transform(l{h}, lambda x: abs(x - b{h})), 'quantile_cont', 0.5), 0.0), 6) + 0.0::DOUBLE AS mad_{h}, {r(f'event - b{h}', f'jump_{h}')}" for h in (10, 20, 60, 120)) + " FROM h")
def multi_horizon(spark: SparkSession, sf: str) -> DataFrame:
    out = W.horizons(W.forward_quartile(frames(spark, sf), (6,)), "p25_6")
    return out.select("clip", "frame", *(r6(c).alias(c) for h in (10, 20, 60, 120) for c in (f"baseline_{h}", f"mad_{h}", f"jump_{h}")))


_P = ", ".join(f"quantile_cont(level, 0.25) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) AS p25_{k}" for k in (2, 6, 12, 20))


@query(f"WITH {FRAMES}, f AS (SELECT *, {_P} FROM frames) SELECT clip, frame, " + ", ".join(r(f"p25_{k}", f"p25_{k}") for k in (2, 6, 12, 20)) + " FROM f")
def forward_p25(spark: SparkSession, sf: str) -> DataFrame:
    return W.forward_quartile(frames(spark, sf)).select("clip", "frame", *(r6(f"p25_{k}").alias(f"p25_{k}") for k in (2, 6, 12, 20)))


SIG = "1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(-30.0::DOUBLE, least(30.0::DOUBLE, {0}))))"
SCORES = MAD + f""", forward AS (SELECT *, quantile_cont(level, 0.25) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS p25_6 FROM maddened),
  selected AS (SELECT clip, frame, n, target, level, jump, pow({SIG.format('(p25_6 + 10.5) / 2.5')}, 0.9) * pow({SIG.format('(p25_6 - baseline - 13.0) / 3.5')}, 1.25)
  * (0.65 + 0.35 * {SIG.format('((p25_6 - baseline) / greatest(2.0, 1.4826 * mad) - 6.0) / 2.0')}) AS score FROM forward WHERE frame >= 22 AND frame < n - 5)"""


def selected(spark: SparkSession, sf: str) -> DataFrame:
    """Scored frames with the selection score of the forward quartile."""
    df = W.forward_quartile(W.trailing_mad(W.trailing_baseline(frames(spark, sf))), (6,)).where(W.scored())
    return df.withColumn("score", W.selection_score(F.col("p25_6"), F.col("p25_6") - F.col("baseline"), F.col("mad")))


@query(f"WITH {SCORES} SELECT clip, frame, {r('score', 'score')} FROM selected")
def selection_score(spark: SparkSession, sf: str) -> DataFrame:
    return selected(spark, sf).select("clip", "frame", r6("score").alias("score"))


_L60, _C59 = (f"(PARTITION BY clip ORDER BY frame ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in (60, 59))


@query(f"""WITH {FRAMES}, d AS (SELECT *, level - lag(level) OVER (PARTITION BY clip ORDER BY frame) AS change FROM frames)
  SELECT clip, frame, coalesce(sum(CASE WHEN change >= 8 THEN 1 ELSE 0 END) OVER {_C59}, 0)::BIGINT AS rises,
  {r(f'coalesce(quantile_cont(level, 0.75) OVER {_L60} - quantile_cont(level, 0.25) OVER {_L60}, 0.0)', 'spread')}, {r(f'coalesce(quantile_cont(abs(change), 0.5) OVER {_C59}, 0.0)', 'derivative')} FROM d""")
def first_difference(spark: SparkSession, sf: str) -> DataFrame:
    return W.differences(frames(spark, sf)).select("clip", "frame", F.col("rises").cast("long").alias("rises"), r6("spread").alias("spread"), r6("derivative").alias("derivative"))


@query(f"""WITH {BASED}, h AS (SELECT *, list(level) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS a,
  list(level) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING) AS b FROM jumped)
  SELECT clip, frame, {r("list_avg(list_transform(a, lambda x: CASE WHEN x >= greatest(-13.0::DOUBLE, baseline + 9.0::DOUBLE) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))", 'held')},
  {r("list_avg(list_transform(b, lambda x: greatest(x - baseline, 0.0::DOUBLE)))", 'excess')} FROM h WHERE frame >= 22 AND frame < n - 5""")
def persistence(spark: SparkSession, sf: str) -> DataFrame:
    return W.persistence(W.trailing_baseline(frames(spark, sf))).where(W.scored()).select("clip", "frame", r6("held").alias("held"), r6("excess").alias("excess"))


@query(f"""WITH {FRAMES}, m AS (SELECT clip, frame, avg(pow(10, level / 10)) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS pb,
  avg(pow(10, level / 10)) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS pa FROM frames)
  SELECT clip, frame, {r('10 * log10(greatest(pa, 1e-12)) - 10 * log10(greatest(pb, 1e-12))', 'rise_db')} FROM m WHERE frame > 0""")
def moving_power(spark: SparkSession, sf: str) -> DataFrame:
    return W.moving_power(frames(spark, sf)).where("frame > 0").select("clip", "frame", r6("rise_db").alias("rise_db"))


POINTS = BASED + """, points AS (SELECT clip, frame AS point FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY jump DESC, frame) AS rn FROM jumped WHERE frame >= 22 AND frame < n - 5) WHERE rn = 1)"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Each clip's frame with the greatest jump."""
    based = W.trailing_baseline(frames(spark, sf)).where(W.scored())
    return W.first_best(based.select("clip", "frame", "jump"), "jump", ["clip"]).select("clip", F.col("frame").alias("point"))


_M = ", ".join(f"CASE WHEN row_number() OVER w >= {k} THEN avg(p) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) END AS m{k}" for k in (5, 10, 20))


@query(f"WITH {POINTS}, s AS (SELECT f.clip, frame, point, pow(10, level / 10) AS p FROM frames f JOIN points ON f.clip = points.clip WHERE frame >= point - 5 AND frame < point + 40), m AS (SELECT clip, point, p, {_M} FROM s WINDOW w AS (PARTITION BY clip ORDER BY frame)) SELECT clip, point, " + ", ".join(r(f"10 * log10(greatest(coalesce(max(m{k}), max(p)), 1e-9))", f"peak_{k}") for k in (5, 10, 20)) + " FROM m GROUP BY clip, point")
def moving_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return W.moving_peaks(frames(spark, sf), points(spark, sf)).select("clip", "point", *(r6(f"peak_{k}").alias(f"peak_{k}") for k in (5, 10, 20)))


@query(f"""WITH {FRAMES}, f AS (SELECT *, {_P} FROM frames), k AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY p25_6 DESC, frame) AS rn FROM f WHERE frame < 21)
  SELECT clip, frame, {r('p25_6', 'p25_6')} FROM k WHERE rn = 1""")
def opening_argmax(spark: SparkSession, sf: str) -> DataFrame:
    first = W.forward_quartile(frames(spark, sf), (6,)).where("frame < 21").select("clip", "frame", "p25_6")
    return W.first_best(first, "p25_6", ["clip"]).select("clip", "frame", r6("p25_6").alias("p25_6"))


@query(f"""WITH {FRAMES}, k AS (SELECT clip, frame // 20 AS block, frame, level, row_number() OVER (PARTITION BY clip, frame // 20 ORDER BY level DESC, frame) AS rn FROM frames)
  SELECT clip, block, frame, {r('level', 'level')} FROM k WHERE rn = 1""")
def block_best(spark: SparkSession, sf: str) -> DataFrame:
    df = frames(spark, sf).select("clip", F.floor(F.col("frame") / 20).alias("block"), "frame", "level")
    return W.first_best(df, "level", ["clip", "block"]).select("clip", "block", "frame", r6("level").alias("level"))


@query(f"""WITH {BASED}, h AS (SELECT clip, frame, n, list_transform(list(level) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN CURRENT ROW AND 119 FOLLOWING), lambda x: x >= baseline + 3) AS a FROM jumped),
  e AS (SELECT *, list_min(list_filter(range(2, len(a) + 1), lambda i: NOT a[i] AND NOT a[i - 1])) AS stop FROM h),
  u AS (SELECT *, list_max(list_filter(range(1, coalesce(stop, len(a) + 1)), lambda i: a[i])) AS last FROM e)
  SELECT clip, frame, round(coalesce(last, 0) * 0.05::DOUBLE, 6) + 0.0::DOUBLE AS run_s FROM u WHERE frame >= 22 AND frame < n - 5""")
def run_length(spark: SparkSession, sf: str) -> DataFrame:
    based = W.trailing_baseline(frames(spark, sf))
    return W.run_length(based, F.col("baseline") + 3).where(W.scored()).select("clip", "frame", r6("run_s").alias("run_s"))


@query(f"""WITH {POINTS}, s AS (SELECT f.clip, frame, level, point FROM frames f JOIN points ON f.clip = points.clip WHERE frame >= point - 300 AND frame < point + 200),
  b AS (SELECT clip, point, coalesce(quantile_cont(level, 0.5) FILTER (frame < point - 5), -90.0::DOUBLE) AS baseline, max(frame) AS last FROM s GROUP BY clip, point),
  k AS (SELECT s.clip, s.point, baseline, last, frame AS pf, level AS peak, row_number() OVER (PARTITION BY s.clip ORDER BY level DESC, frame) AS rn FROM s JOIN b ON s.clip = b.clip WHERE frame >= s.point AND frame < s.point + 30),
  t AS (SELECT *, greatest(baseline + 6, peak - 10) AS least_level FROM k WHERE rn = 1)
  SELECT t.clip, t.point, pf AS peak_frame, {r('peak', 'peak')}, {r('baseline', 'baseline')},
    (pf - coalesce(max(CASE WHEN level < least_level AND frame < pf AND frame >= t.point - 10 THEN frame END) + 1, greatest(0, t.point - 10)))::BIGINT AS left_run,
    (coalesce(min(CASE WHEN level < least_level AND frame > pf THEN frame END), last + 1) - pf - 1)::BIGINT AS right_run
  FROM s JOIN t ON s.clip = t.clip GROUP BY t.clip, t.point, pf, peak, baseline, last""")
def peak_run(spark: SparkSession, sf: str) -> DataFrame:
    out = W.peak_run(frames(spark, sf), points(spark, sf))
    return out.select("clip", "point", "peak_frame", r6("peak").alias("peak"), r6("baseline").alias("baseline"), F.col("left").cast("long").alias("left_run"), F.col("right").cast("long").alias("right_run"))


@query(f"""WITH {FRAMES}, o AS (SELECT clip, frame, greatest(level - lag(level) OVER (PARTITION BY clip ORDER BY frame), 0.0) / (1.0::DOUBLE + exp(-greatest(-30.0, least(30.0, (level - 40.0 + 25.0) / 6.0)))) AS d FROM frames),
  c AS (SELECT clip, count(*) AS k FROM o WHERE frame > 0 GROUP BY clip),
  l AS (SELECT a.clip, g.lag, sum(a.d * b.d) AS ab, sqrt(sum(a.d * a.d)) * sqrt(sum(b.d * b.d)) AS norms FROM o a CROSS JOIN range(5, 21) g(lag) JOIN o b ON a.clip = b.clip AND b.frame = a.frame + g.lag JOIN c ON a.clip = c.clip WHERE a.frame > 0 AND g.lag < k // 2 GROUP BY 1, 2)
  SELECT c.clip, round(CASE WHEN k >= 40 THEN greatest(0.0, coalesce(max(CASE WHEN norms > 1e-8 THEN ab / norms END), 0.0)) END, 6) + 0.0::DOUBLE AS rhythm FROM c LEFT JOIN l ON c.clip = l.clip GROUP BY c.clip, k""")
def autocorrelation(spark: SparkSession, sf: str) -> DataFrame:
    """Levels 40 dB lower, as clips' are; lags and rises of the fewer rows that clips have here."""
    quiet = frames(spark, sf).withColumn("level", F.col("level") - 40.0)
    return W.autocorrelation(quiet, 5, 20, 40).select("clip", r6("rhythm").alias("rhythm"))


_NMS = """, g1 AS (SELECT clip, frame, score FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY score DESC, frame) AS rn FROM {t}) WHERE rn = 1),
  l2 AS (SELECT t.* FROM {t} t JOIN g1 ON t.clip = g1.clip WHERE abs(t.frame - g1.frame) >= 20),
  g2 AS (SELECT clip, frame, score FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY score DESC, frame) AS rn FROM l2) WHERE rn = 1),
  l3 AS (SELECT t.* FROM l2 t JOIN g2 ON t.clip = g2.clip WHERE abs(t.frame - g2.frame) >= 20),
  g3 AS (SELECT clip, frame, score FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY score DESC, frame) AS rn FROM l3) WHERE rn = 1),
  nms AS (SELECT clip, 1 AS rank, frame, score FROM g1 UNION ALL SELECT clip, 2, frame, score FROM g2 UNION ALL SELECT clip, 3, frame, score FROM g3)"""


@query(f"WITH {WINDOWS}, w AS (SELECT clip, frame, p AS score FROM windows)" + _NMS.format(t="w") + f" SELECT clip, rank, frame, {r('score', 'score')} FROM nms")
def greedy_nms(spark: SparkSession, sf: str) -> DataFrame:
    picked = T.greedy_separated(windows(spark, sf).withColumn("score", F.col("p")), "score")
    return picked.select("clip", "rank", "frame", r6("score").alias("score"))


@query()
def short_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Further picks clear of the greedy ones; a greedy choice of four, tested in steps."""
    scored = windows(spark, sf).withColumn("score", F.greatest(F.col("jump"), F.lit(0.0)) * F.col("p"))
    originals = T.greedy_separated(scored, "score")
    return T.short_proposals(scored, "score", originals).select("clip", "rank", "frame", r6("score").alias("score"))


@query(f"WITH {WINDOWS}, k AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY p DESC, frame) AS rank FROM windows) SELECT clip, rank, frame, {r('p', 'p')} FROM k WHERE rank <= 5")
def topk_windows(spark: SparkSession, sf: str) -> DataFrame:
    return T.top_k(windows(spark, sf), 5, ["clip"], F.col("p").desc(), "frame").select("clip", "rank", "frame", r6("p").alias("p"))


@query("SELECT arg_max(source, struct_pack(a := length(source), b := source)) AS latest FROM documents")
def latest_fold(spark: SparkSession, sf: str) -> DataFrame:
    from emberline.sources.tables import table

    return T.latest(table(spark, sf, "documents", "source"), "source")


@query(f"WITH {WINDOWS} SELECT clip, {r('max(p)', 'score')}, (min(struct_pack(a := -p, b := frame))).b AS event_at FROM windows GROUP BY clip")
def max_pool(spark: SparkSession, sf: str) -> DataFrame:
    return A.max_pool(windows(spark, sf)).select("clip", r6("score").alias("score"), "event_at")


@query(f"WITH {WINDOWS} SELECT clip, {r('sum(p * p) / greatest(sum(p), 1e-12)', 'score')} FROM windows GROUP BY clip")
def linear_softmax_pool(spark: SparkSession, sf: str) -> DataFrame:
    return windows(spark, sf).groupBy("clip").agg(r6(A.linear_softmax(F.col("p"))).alias("score"))


@query(f"WITH {WINDOWS} SELECT clip, {r('sum(pow(greatest(p, 1e-15), 2)) / greatest(sum(pow(greatest(p, 1e-15), 1)), 1e-300)', 'power_2')}, {r('sum(pow(greatest(p, 1e-15), 8)) / greatest(sum(pow(greatest(p, 1e-15), 7)), 1e-300)', 'power_8')} FROM windows GROUP BY clip")
def power_pool(spark: SparkSession, sf: str) -> DataFrame:
    return windows(spark, sf).groupBy("clip").agg(r6(A.power_pool(F.col("p"), 2)).alias("power_2"), r6(A.power_pool(F.col("p"), 8)).alias("power_8"))


@query(f"""WITH {FRAMES}, known AS (SELECT clip, frame, target FROM frames WHERE target >= 0), u AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY clip) AS u FROM known)
  SELECT clip, frame, target, {r('u * (SELECT count(DISTINCT clip) FROM known) / 2.0 / sum(u) OVER (PARTITION BY target)', 'weight')} FROM u""")
def clip_weights(spark: SparkSession, sf: str) -> DataFrame:
    known = frames(spark, sf).where("target >= 0").select("clip", "frame", "target")
    return A.clip_weights(known).select("clip", "frame", "target", r6("weight").alias("weight"))


_KIND = "CASE WHEN doc_id % 5 = 0 THEN 'synthetic' ELSE 'real' END AS kind, CASE WHEN doc_id % 3 = 0 THEN 'positive' ELSE 'negative' END AS label, source"


@query(f"""WITH k AS (SELECT doc_id, {_KIND} FROM documents), s AS (SELECT kind, label, count(DISTINCT source) AS sources FROM k GROUP BY 1, 2), c AS (SELECT kind, label, source, count(*) AS copies FROM k GROUP BY 1, 2, 3)
  SELECT k.doc_id, k.kind, k.label, k.source, {r("CASE k.kind WHEN 'real' THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END / 2.0 / sources / copies", 'weight')}
  FROM k JOIN s ON k.kind = s.kind AND k.label = s.label JOIN c ON k.kind = c.kind AND k.label = c.label AND k.source = c.source""")
def source_weights(spark: SparkSession, sf: str) -> DataFrame:
    from emberline.sources.tables import table

    docs = table(spark, sf, "documents", "doc_id", "source").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "synthetic").otherwise("real").alias("kind"), F.when(F.col("doc_id") % 3 == 0, "positive").otherwise("negative").alias("label"), "source")
    return A.source_weights(docs, {"real": 1.0, "synthetic": 0.2}).select("doc_id", "kind", "label", "source", r6("weight").alias("weight"))


@query(f"""WITH k AS (SELECT doc_id, doc_id % 5 <> 0 AS real, CASE WHEN doc_id % 3 = 0 THEN 'positive' ELSE 'negative' END AS label, source AS donor, 1.0::DOUBLE + doc_id % 4 AS own FROM documents),
  c AS (SELECT label, donor, count(*) AS copies FROM k WHERE NOT real GROUP BY 1, 2), d AS (SELECT label, count(*) AS donors FROM c GROUP BY 1)
  SELECT doc_id, real, k.label, k.donor, {r("CASE WHEN real THEN 0.8::DOUBLE * own ELSE (SELECT sum(own) FROM k WHERE real) * (1.0::DOUBLE - 0.8::DOUBLE) / 2.0 / donors / copies END", 'weight')}
  FROM k LEFT JOIN c ON k.label = c.label AND k.donor = c.donor LEFT JOIN d ON k.label = d.label""")
def donor_weights(spark: SparkSession, sf: str) -> DataFrame:
    from emberline.sources.tables import table

    docs = table(spark, sf, "documents", "doc_id", "source").select("doc_id", (F.col("doc_id") % 5 != 0).alias("real"), F.when(F.col("doc_id") % 3 == 0, "positive").otherwise("negative").alias("label"), F.col("source").alias("donor"), (1.0 + F.col("doc_id") % 4).alias("own"))
    return A.donor_weights(docs).select("doc_id", "real", "label", "donor", r6("weight").alias("weight"))


@query(f"""WITH {WINDOWS}, k AS (SELECT clip, frame, row_number() OVER (PARTITION BY clip ORDER BY p DESC, frame) AS rn, count(*) OVER (PARTITION BY clip) AS m FROM windows)
  SELECT clip, frame, {r('0.25::DOUBLE / m + CASE WHEN rn <= 3 THEN 0.75::DOUBLE / least(m, 3) ELSE 0 END', 'weight')} FROM k""")
def hard_negative_weights(spark: SparkSession, sf: str) -> DataFrame:
    return A.hard_negative_weights(windows(spark, sf), 0.75, 3).select("clip", "frame", r6("weight").alias("weight"))


@query(f"WITH {WINDOWS}, s AS (SELECT clip, max(p) AS score FROM windows GROUP BY clip) SELECT round(coalesce(least(1.0, max(CASE WHEN clip % 3 = 1 THEN score END) + 1e-9), 1.0), 9) AS threshold FROM s")
def conservative_threshold(spark: SparkSession, sf: str) -> DataFrame:
    pooled = A.max_pool(windows(spark, sf)).withColumn("negative", F.col("clip") % 3 == 1)
    return A.conservative_threshold(pooled).select(F.round("threshold", 9).alias("threshold"))


_PROFILE = "list_transform([value, event_id % 97 + 1.0::DOUBLE, 500.0::DOUBLE - value], lambda x: x / (event_id % 97 + 501.0::DOUBLE))"


@query(f"""WITH {FRAMES}, prof AS (SELECT clip, frame, {_PROFILE} AS p, lead({_PROFILE}) OVER (PARTITION BY clip ORDER BY frame) AS q FROM frames),
  ev AS (SELECT clip, frame, CASE WHEN q IS NULL THEN p ELSE [(p[1] + q[1]) / 2, (p[2] + q[2]) / 2, (p[3] + q[3]) / 2] END AS e FROM prof),
  pairs AS (SELECT a.clip, a.frame, sqrt((pow(sqrt(e[1]) - sqrt(p[1]), 2) + pow(sqrt(e[2]) - sqrt(p[2]), 2) + pow(sqrt(e[3]) - sqrt(p[3]), 2)) / 2) AS d FROM ev a JOIN prof b ON a.clip = b.clip
    AND a.frame - b.frame BETWEEN 11 AND 160 AND (b.frame - greatest(0, a.frame - 160)) % 5 = 0) SELECT clip, frame, {r('min(d)', 'recurrence')} FROM pairs GROUP BY clip, frame""")
def recurrence(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of each frame's profile to the nearest of every fifth earlier one."""
    rest = F.col("event_id") % 97
    profile = F.transform(F.array(F.col("value"), (rest + 1.0).cast("double"), 500.0 - F.col("value")), lambda x: x / (rest + 501.0))
    return W.recurrence(frames(spark, sf).withColumn("profile", profile)).where("recurrence is not null").select("clip", "frame", r6("recurrence").alias("recurrence"))


@query(f"""WITH {WINDOWS}, w AS (SELECT clip, frame, p AS score FROM windows)""" + _NMS.format(t="w") + f""", pooled AS (SELECT clip, sum(p * p) / greatest(sum(p), 1e-12) AS score FROM windows GROUP BY clip)
  SELECT pooled.clip, {r('pooled.score', 'score')}, {TIER.format('pooled.score')} AS tier, string_agg(nms.frame, ',' ORDER BY rank) AS events FROM pooled JOIN nms ON pooled.clip = nms.clip GROUP BY pooled.clip, pooled.score""")
def detect(spark: SparkSession, sf: str) -> DataFrame:
    """The whole detector: timeline, baseline, window scores, pooled tier, separate events."""
    scored = windows(spark, sf)
    events = T.greedy_separated(scored.withColumn("score", F.col("p")), "score").groupBy("clip").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("rank", "frame"))), lambda x: x["frame"].cast("string"))).alias("events"))
    pooled = scored.groupBy("clip").agg(A.linear_softmax(F.col("p")).alias("score"))
    return pooled.join(events, "clip").select("clip", r6("score").alias("score"), risk_tier(F.col("score")).alias("tier"), "events")


_Q = [(10, 0.1), (25, 0.25), (50, 0.5), (75, 0.75), (95, 0.95), (99, 0.99)]


@query(f"WITH {FRAMES} SELECT clip, " + ", ".join(r(f"quantile_cont(level, {q})", f"p{n}") for n, q in _Q) + f""", {r('quantile_cont(level, 0.95) - quantile_cont(level, 0.1)', 'dynamic_range')},
  {r('avg(CASE WHEN level >= 24 THEN 1.0::DOUBLE ELSE 0 END)', 'loud')}, {r('avg(CASE WHEN level <= 10 THEN 1.0::DOUBLE ELSE 0 END)', 'quiet')} FROM frames GROUP BY clip""")
def clip_level_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A clip's level percentiles, range, and shares of loud and quiet frames."""
    f = frames(spark, sf)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return f.groupBy("clip").agg(
        *(r6(F.percentile("level", F.lit(q))).alias(f"p{n}") for n, q in _Q), r6(F.percentile("level", F.lit(0.95)) - F.percentile("level", F.lit(0.1))).alias("dynamic_range"),
        r6(share(F.col("level") >= 24)).alias("loud"), r6(share(F.col("level") <= 10)).alias("quiet"),
    )


@query(f"""WITH {WINDOWS}, w AS (SELECT clip, frame, p AS score FROM windows)""" + _NMS.format(t="w") + """, blk AS (SELECT clip, frame FROM (SELECT clip, frame, row_number() OVER (PARTITION BY clip, frame // 20 ORDER BY p DESC, frame) AS rn FROM windows) WHERE rn = 1),
  opening AS (SELECT clip, frame FROM (SELECT clip, frame, row_number() OVER (PARTITION BY clip ORDER BY level DESC, frame) AS rn FROM frames WHERE frame < 21) WHERE rn = 1)
  SELECT clip, frame FROM nms UNION SELECT clip, frame FROM blk UNION SELECT clip, frame FROM opening""")
def proposal_union(spark: SparkSession, sf: str) -> DataFrame:
    """Separate picks, the best of each block and the opening, each frame once."""
    w = windows(spark, sf)
    picks = T.greedy_separated(w.withColumn("score", F.col("p")), "score").select("clip", F.col("frame").cast("long").alias("frame"))
    blocks = W.first_best(w.select("clip", F.floor(F.col("frame") / 20).alias("block"), "frame", "p"), "p", ["clip", "block"]).select("clip", F.col("frame").cast("long").alias("frame"))
    first = W.first_best(frames(spark, sf).where("frame < 21").select("clip", "frame", "level"), "level", ["clip"]).select("clip", F.col("frame").cast("long").alias("frame"))
    return picks.unionByName(blocks).unionByName(first).distinct()


@query(f"""WITH {FRAMES}, t AS (SELECT h.held, f.clip FROM (SELECT DISTINCT clip % 7 AS held FROM frames) h, (SELECT DISTINCT clip FROM frames) f WHERE f.clip % 7 <> h.held AND f.clip % 14 <> h.held),
  k AS (SELECT held, sha256(string_agg(clip::VARCHAR, ',' ORDER BY clip)) AS training_key FROM t GROUP BY held) SELECT training_key, count(*) AS folds, min(held) AS first FROM k GROUP BY training_key""")
def training_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Folds that share a training set share its key, and so its fit."""
    users = frames(spark, sf).select("clip").distinct()
    held = F.explode(F.sequence(F.lit(0), F.lit(6))).alias("held")
    t = users.select("clip", held).where((F.col("clip") % 7 != F.col("held")) & (F.col("clip") % 14 != F.col("held")))
    key = F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("clip")), lambda c: c.cast("string"))), 256)
    return t.groupBy("held").agg(key.alias("training_key")).groupBy("training_key").agg(F.count(F.lit(1)).alias("folds"), F.min("held").cast("long").alias("first"))
