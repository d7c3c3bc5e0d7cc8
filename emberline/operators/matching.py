"""Partial matches by landmark tokens and an inverted index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import Rounds

# How a match is accepted.
COMMON = 100
ANCHORS, HASHES, BINS, FRACTION = 6, 8, 3, 0.25
#: Rows of references or pairs that are sent to all tasks, at most (40 bytes each).
HELD = 500_000


def held(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it has at most :data:`HELD` rows."""
    return F.broadcast(df) if df.limit(HELD + 1).count() <= HELD else df


def fan_out(peaks: DataFrame, item: str = "item", frame: str = "frame", low: int = 3, high: int = 60, most: int = 8) -> DataFrame:
    """For each peak the ``most`` loudest of those ``low`` to ``high`` frames later.

    Peaks meet by blocks of ``high + 1`` frames, so this is an equality join on
    item and block.
    """
    size = high + 1
    block = F.floor(F.col(frame) / size)
    later = peaks.select(F.col(item), F.col(frame).alias("frame2"), F.col("bin").alias("bin2"), F.col("loud").alias("loud2"), block.alias("block"))
    first = peaks.withColumn("block", F.explode(F.array(block, block + 1)))
    pairs = first.join(later, [item, "block"]).where((F.col("frame2") - F.col(frame) >= low) & (F.col("frame2") - F.col(frame) <= high))
    w = Window.partitionBy(item, frame, "bin").orderBy(F.col("loud2").desc(), "frame2", "bin2")
    return pairs.drop("block").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def common_tokens_off(postings: DataFrame, token: str = "token", most: int = COMMON) -> DataFrame:
    """Postings without tokens that occur more than ``most`` times; a part of the
    match's definition.  Counted before the join, as windows would gather them."""
    rare = postings.groupBy(token).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= most).select(token)
    return postings.join(rare, token)


def near_tokens(tokens: Column) -> Column:
    """Tokens and those whose last nine bits are one off, each once."""
    low = lambda t: t.bitwiseAND(F.lit(511))
    each = F.transform(tokens, lambda t: F.filter(F.array(t - 1, t, t + 1), lambda u: F.shiftright(u, 9) == F.shiftright(t, 9)))
    return F.array_distinct(F.flatten(each))


def index_match(query: DataFrame, postings: DataFrame, slack: bool = True) -> DataFrame:
    """Query tokens joined to postings of equal tokens or, with ``slack``, of tokens
    with the last nine bits one off: ``query, reference, token, anchor, at``, each hit once.

    ``query`` has ``query, frame`` and either a ``token`` or, one row a frame,
    ``tokens``.  Postings that are few are sent to the queries, so that query
    tokens without a posting are never shuffled; with ``tokens`` nothing is.
    """
    whole = "tokens" in query.columns
    own = F.col("tokens") if whole else F.array("token")
    each = query.select("query", F.col("frame").alias("anchor"), F.explode(near_tokens(own) if slack else F.array_distinct(own)).alias("token"))
    found = each.join(held(postings.select("reference", "token", F.col("frame").alias("at")).distinct()), "token").select("query", "reference", "token", "anchor", "at")
    return found if whole else found.distinct()


def offset_counts(matches: DataFrame) -> DataFrame:
    """Hits of each pair's rounded offsets (thirds, half to even)."""
    return matches.groupBy("query", "reference", F.rint((F.col("anchor") - F.col("at")) / 3.0).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("hits"))


def offset_modes(matches: DataFrame, most: int = 3) -> DataFrame:
    """The commonest rounded offsets of each pair."""
    w = Window.partitionBy("query", "reference").orderBy(F.col("hits").desc(), "bucket")
    return offset_counts(matches).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def accept(matches: DataFrame, references: DataFrame, rate: float = 100.0) -> DataFrame:
    """Each pair's best offset: the hits at most three frames off it must have
    enough distinct reference frames, tokens and bins, a large enough part of the
    reference's frames and span; most frames win, then more hits.

    ``references(reference, anchors, duration_s)``.  Such hits lie in three
    neighbouring buckets, so a pair is left out whose fullest bucket holds less
    than a third of what is needed, then one whose fullest three in a row hold
    less; only the hits of the others are gathered.  The hits are written once,
    as they are counted and then gathered.
    """
    least = F.greatest(F.lit(max(ANCHORS, HASHES)), F.ceil(FRACTION * F.col("anchors")))
    known, rounds = held(references), Rounds(matches.sparkSession)
    hits = rounds.next(matches)
    counts = rounds.next(offset_counts(hits))
    third = counts.where(3 * F.col("hits") >= max(ANCHORS, HASHES)).join(known, "reference").where(3 * F.col("hits") >= least).select("query", "reference").distinct()
    rows = counts.join(third, ["query", "reference"], "left_semi").select("query", "reference", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("b"), "hits")
    three = rows.groupBy("query", "reference", "b").agg(F.sum("hits").alias("hits")).where(F.col("hits") >= max(ANCHORS, HASHES)).join(known, "reference").where(F.col("hits") >= least)
    pairs = rounds.next(three.select("query", "reference").distinct())
    some = rounds.next(hits.join(held(pairs), ["query", "reference"]))
    near = some.withColumn("offset", F.col("anchor") - F.col("at")).join(offset_modes(some), ["query", "reference"]).where(F.abs(F.col("offset") - 3 * F.col("bucket")) <= 3)
    found = near.groupBy("query", "reference", "bucket", "hits").agg(
        F.count_distinct("at").alias("anchors_hit"), F.count_distinct("token").alias("tokens_hit"), F.count_distinct(F.shiftright("token", 18)).alias("bins_hit"),
        (F.max("at") - F.min("at")).alias("span"), F.percentile("offset", F.lit(0.5)).alias("offset"),
    )
    return rounds.last(accepted(found, known, rate))


def accepted(found: DataFrame, references: DataFrame, rate: float = 100.0) -> DataFrame:
    """The best of each pair's offsets that hold enough: :func:`accept` from there on."""
    fine = found.join(references, "reference").withColumn("fraction", F.col("anchors_hit") / F.col("anchors")).where(
        (F.col("anchors_hit") >= ANCHORS) & (F.col("tokens_hit") >= HASHES) & (F.col("bins_hit") >= BINS) & (F.col("fraction") >= FRACTION)
        & (F.col("span") / rate >= F.least(F.lit(0.15), 0.3 * F.col("duration_s")))
    )
    w = Window.partitionBy("query", "reference").orderBy(F.col("anchors_hit").desc(), F.col("hits").desc(), "bucket")
    return fine.withColumn("best", F.row_number().over(w)).where("best = 1").drop("best")


def exact_shortcut(queries: DataFrame, references: DataFrame, digest: str = "digest") -> tuple[DataFrame, DataFrame]:
    """Pairs of equal content, and the queries that still need matching."""
    exact = queries.select("query", digest).join(references.select("reference", digest), digest).select("query", "reference")
    return exact, queries.join(exact.select("query").distinct(), "query", "left_anti")


def match_summary(queries: DataFrame, matches: DataFrame, label: str = "label") -> DataFrame:
    """Per label: queries, and those with a match."""
    hit = matches.select("query").distinct().withColumn("_hit", F.lit(1))
    return queries.join(hit, "query", "left").groupBy(label).agg(F.count(F.lit(1)).alias("queries"), F.sum(F.coalesce("_hit", F.lit(0))).alias("matched"))


def word_landmarks(df: DataFrame, key: str, text: str, gap: int = 8) -> DataFrame:
    """``key, frame, tokens``: landmarks of texts, pairs of words up to ``gap`` apart
    as packed tokens with the first word's place, each once.

    Words become nine-bit codes first, and the words that follow come from one
    window over each text, so no Python and no nested lambdas run.
    """
    words = F.filter(F.split(F.col(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = df.select(key, F.posexplode(words).alias("frame", "w")).select(key, "frame", F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(511)).alias("c"))
    w = Window.partitionBy(key).orderBy("frame")
    ahead = rows.select(key, "frame", "c", *(F.lead("c", k).over(w).alias(f"c{k}") for k in range(1, gap + 1)))
    pair = lambda k: F.shiftleft("c", 18).bitwiseOR(F.shiftleft(f"c{k}", 9)).bitwiseOR(F.lit(k // 2).cast("long"))
    return ahead.select(key, "frame", F.array_distinct(F.array_compact(F.array(*(pair(k) for k in range(1, gap + 1))))).alias("tokens"))


def word_postings(df: DataFrame, key: str, text: str, gap: int = 8) -> DataFrame:
    """``key, token, frame``: :func:`word_landmarks`, a row each."""
    return word_landmarks(df, key, text, gap).select(key, F.explode("tokens").alias("token"), "frame")


def evaluation(queries: DataFrame, matches: DataFrame) -> DataFrame:
    """One row on labelled queries: how many are negative, match a reference or one
    confirmed, and how many are positive and match a reference other than themselves.

    ``queries(query, label, digest)``, ``matches(query, reference_digest, confirmed)``; a match
    with the query's own content doesn't count.
    """
    own = queries.select("query", "digest")
    other = matches.join(own, "query").where(F.col("reference_digest") != F.col("digest")).groupBy("query").agg(F.max("confirmed").alias("confirmed"))
    held_ = queries.join(other.withColumn("hit", F.lit(True)), "query", "left")
    count = lambda *c: F.count(F.when(reduce(lambda a, b: a & b, c), 1))
    negative, positive, hit = F.col("label") == "negative", F.col("label") == "positive", F.coalesce("hit", F.lit(False))
    return held_.agg(
        count(negative).alias("negative"), count(negative, hit).alias("negative_matched"), count(negative, hit, F.coalesce("confirmed", F.lit(False))).alias("negative_confirmed"),
        count(positive).alias("positive"), count(positive, hit).alias("positive_matched"),
    )


def robustness(changed: DataFrame, matches: DataFrame) -> DataFrame:
    """For each ``variant`` of references ``changed(query, variant, digest)``, how many there are
    and how many match the reference that they were made from, ``matches(query, variant, reference_digest)``."""
    found = matches.select("query", "variant", F.col("reference_digest").alias("digest")).distinct().withColumn("_hit", F.lit(1))
    return changed.join(found, ["query", "variant", "digest"], "left").groupBy("variant").agg(F.count(F.lit(1)).alias("total"), F.count("_hit").alias("recovered"))
