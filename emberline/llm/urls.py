"""URL filters: listed rules, and association rules mined from labelled URLs.

Listed rules fit a host with all its subdomains and a path prefix; the longest
wins.  URLs that no listed rule fits are judged by rules that Spark's FP-growth
mines from labelled URLs: combinations of URL tokens that go with the label
``block``, pruned by support and confidence, matched by an inverted index from
each rule's rarest token to the rule.  Where URLs have no labels of their own,
:func:`known_labels` makes some from what is known of hosts and from the listed
rules.  Everything is a DataFrame operation, and applying rules needs no shuffle
while they are few; more are joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this number are matched as a literal; more by a join.
LITERAL_RULES = 2000
BLOCK, ALLOW = "label=block", "label=allow"
# Words of hosts that are taken for unwanted when URLs are labelled.
UNWANTED = ("adult", "ads", "bet", "bets", "casino", "cheap", "escort", "pills", "poker", "porn", "spam", "torrent", "viagra", "warez", "xxx")


def url_host(url: F.Column) -> F.Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: F.Column) -> F.Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _column(c: str | F.Column) -> F.Column:
    return F.col(c) if isinstance(c, str) else c


def _by_host(rules: Sequence[tuple[str, str, str]]) -> int:
    """Labels of the longest host among the rules."""
    return max((h.count(".") + 1 for _, h, _ in rules), default=0)


def _ends(host: F.Column, most: int) -> F.Column:
    """The host's last labels, as many as ``most`` and fewer."""
    return F.array_distinct(F.array(*(F.substring_index(host, ".", -k) for k in range(1, most + 1))))


def listed_rule(host: F.Column, path: F.Column, rules: Sequence[tuple[str, str, str]]) -> F.Column:
    """The longest fitting rule as ``struct<rule, verdict>``, or null.

    ``rules`` are (verdict, host, path), few enough for an expression.  They are
    looked up by the host's last labels, as many as any rule's host has.
    """
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    by_host: dict[str, list] = {}
    for verdict, h, p in rules:
        by_host.setdefault(h, []).append(F.struct(F.lit(len(h + p)).alias("size"), F.lit(len(h)).alias("deep"), F.lit(p).alias("path"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
    table = F.create_map(*(x for h, own in by_host.items() for x in (F.lit(h), F.array(*own))))
    none = F.array().cast("array<struct<size:int,deep:int,path:string,rule:string,verdict:string>>")
    fitting = F.flatten(F.transform(_ends(host, _by_host(rules)), lambda h: F.filter(F.coalesce(F.element_at(table, h), none), lambda r: F.startswith(path, r["path"]))))
    best = F.array_max(fitting)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def with_listed(df: DataFrame, rules: Sequence[tuple[str, str, str]], host: str, path: str, to: str) -> DataFrame:
    """``df`` with ``to``: :func:`listed_rule` as an expression, or by a join of the
    distinct hosts and paths if there are more than :data:`LITERAL_RULES`."""
    if len(rules) <= LITERAL_RULES:
        return df.withColumn(to, listed_rule(F.col(host), F.col(path), rules))
    listed = df.sparkSession.createDataFrame([(len(h + p), len(h), p, h + p, v, h) for v, h, p in rules], "size int, deep int, rule_path string, rule string, verdict string, end string")
    pairs = df.select(F.col(host).alias("h"), F.col(path).alias("p")).distinct()
    fits = pairs.withColumn("end", F.explode(_ends(F.col("h"), _by_host(rules)))).join(listed, "end").where(F.startswith("p", "rule_path"))
    best = fits.groupBy("h", "p").agg(F.max(F.struct("size", "deep", "rule", "verdict")).alias("best")).select("h", "p", F.struct("best.rule", "best.verdict").alias(to))
    return df.join(best, (F.col(host) == F.col("h")) & (F.col(path) == F.col("p")), "left").drop("h", "p")


def known_labels(df: DataFrame, rules: Sequence[tuple[str, str, str]], url: str = "url", unwanted: Sequence[str] = UNWANTED) -> DataFrame:
    """``url, block`` of every URL that is not null: true if a word of its host, between
    dots and hyphens, is ``unwanted`` or a listed rule blocks it."""
    seen = df.where(F.col(url).isNotNull()).select(F.col(url).alias("url")).withColumn("_host", url_host(F.col("url"))).withColumn("_path", url_path(F.col("url")))
    words = F.arrays_overlap(F.split("_host", "[.-]"), F.array(*map(F.lit, unwanted)))
    return with_listed(seen, rules, "_host", "_path", "_rule").select("url", (words | F.coalesce(F.col("_rule.verdict") == "block", F.lit(False))).alias("block"))


def url_tokens(url: F.Column, host: F.Column, path: F.Column) -> F.Column:
    """The whole URL's features: host labels, the last two of them as a pair, path
    segments, file ending and query keys."""
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    keys = F.regexp_extract_all(F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit("")), F.lit(r"(?:^|&)([^=&]+)"), 1)
    tagged = F.concat(
        F.transform(labels, lambda s: F.concat(F.lit("host="), s)),
        F.array(F.concat(F.lit("site="), F.substring_index(host, ".", -2))),
        F.transform(segments, lambda s: F.concat(F.lit("path="), s)),
        F.transform(keys, lambda s: F.concat(F.lit("key="), s)),
        F.array(F.concat(F.lit("ends="), F.regexp_extract(path, r"\.([A-Za-z0-9]{1,6})$", 1))),
    )
    return F.array_distinct(F.filter(tagged, lambda s: ~F.endswith(s, F.lit("=")) & s.isNotNull()))


RULES = "antecedent array<string>, confidence double, support double, anchor string"


def mine_rules(labelled: DataFrame, tokens: str = "tokens", block: str = "block", support: float = 0.0, least: int = 20, confidence: float = 0.8) -> DataFrame:
    """``antecedent, confidence, support, anchor``: token sets that go with the label block.

    A rule needs ``least`` blocked rows and ``confidence``, one of several tokens
    also ``support`` of the labelled rows (no share by default, so that a long tail of hosts
    has rules however many rows there are); one that a shorter rule of no less
    confidence covers is left out.  ``anchor`` is its rarest token.  No labelled
    rows: no rules.

    URLs are of any length, so FP-growth is given what can make rules only:
    tokens with that many blocked rows, no token that is a rule of confidence 1
    by itself, as it covers all rules it is in, and one of the tokens that occur
    in the same rows, whose rules then hold for each of them.  Rules of single
    tokens follow from their counts.
    """
    spark = labelled.sparkSession
    rows = cut(labelled.where(F.col(block).isNotNull() & F.col(tokens).isNotNull()).select(F.monotonically_increasing_id().alias("id"), F.col(tokens).alias("tokens"), F.col(block).alias("block")))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], RULES)
    need = max(1, ceil(min(1.0, max(support, least / n)) * n - 1e-6))
    each = rows.select("id", "block", F.explode("tokens").alias("item"))
    # equal sums of two hashes of the rows: the same rows
    marks = [F.sum(F.xxhash64(F.lit(seed), "id").cast("decimal(20,0)")).alias(f"rows{seed}") for seed in (1, 2)]
    counts = cut(each.groupBy("item").agg(F.count(F.lit(1)).alias("freq"), F.sum(F.col("block").cast("long")).alias("blocked"), *marks).where(F.col("blocked") >= least))
    sure = F.col("blocked") / F.col("freq")
    single = counts.where(sure >= confidence).select(F.array("item").alias("antecedent"), sure.alias("confidence"), (F.col("blocked") / n).alias("support"), F.col("item").alias("anchor"))
    same = counts.where((F.col("blocked") < F.col("freq")) & (F.col("blocked") >= need)).groupBy("freq", "rows1", "rows2").agg(F.min("item").alias("item"), F.collect_list("item").alias("equal"))
    same = cut(same.select("item", "freq", "equal"))
    items = cut(each.join(same.select("item"), "item").groupBy("id").agg(F.collect_list("item").alias("items"), F.first("block").alias("block"))
        .select(F.concat("items", F.array(F.when(F.col("block"), F.lit(BLOCK)).otherwise(F.lit(ALLOW)))).alias("items")))
    m = items.count()
    if not m:
        return single
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (need - 0.5) / m), minConfidence=confidence).fit(items)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK)).select(F.array_sort("antecedent").alias("antecedent"), "confidence", (F.col("support") * m / n).alias("support"))
    anchored = cut(rules.withColumn("item", F.explode("antecedent")).join(same, "item").groupBy("antecedent", "confidence", "support").agg(F.min_by("item", F.struct("freq", "item")).alias("anchor"), F.collect_list(F.struct("item", "equal")).alias("of")))
    # a covering rule's anchor is one of the covered rule's tokens
    a, b = anchored.alias("a"), anchored.select(F.col("antecedent").alias("shorter"), F.col("confidence").alias("sure"), F.col("anchor").alias("at"))
    covered = (
        a.withColumn("at", F.explode("antecedent")).join(b, "at")
        .where((F.size("shorter") < F.size("antecedent")) & (F.col("sure") >= F.col("confidence")) & (F.size(F.array_except("shorter", "antecedent")) == 0))
        .select("antecedent").distinct()
    )
    left = anchored.where(F.size("antecedent") > 1).join(covered, "antecedent", "left_anti")
    # each token that stands for others gives way to each of them, the anchor first
    first = F.filter("of", lambda o: o["item"] == F.col("anchor"))
    rest = F.filter("of", lambda o: o["item"] != F.col("anchor"))
    every = F.aggregate(F.concat(first, rest), F.array(F.array().cast("array<string>")), lambda got, o: F.flatten(F.transform(got, lambda g: F.transform(o["equal"], lambda t: F.concat(g, F.array(t))))))
    spread = left.select("confidence", "support", F.explode(every).alias("own"))
    return spread.select(F.array_sort("own").alias("antecedent"), "confidence", "support", F.col("own")[0].alias("anchor")).unionByName(single)


def mined_block(df: DataFrame, rules: DataFrame, url: str, tokens: str, to: str) -> DataFrame:
    """``df`` with ``to``: whether any mined rule's tokens are all among ``tokens``."""
    # one row over the bound tells that the rules are too many for a literal
    some = rules.select("anchor", "antecedent").limit(LITERAL_RULES + 1).collect()
    if len(some) <= LITERAL_RULES:
        index: dict[str, list] = {}
        for r in some:
            index.setdefault(r.anchor, []).append(F.array(*map(F.lit, r.antecedent)))
        if not index:
            return df.withColumn(to, F.lit(False))
        table = F.create_map(*(x for a, own in index.items() for x in (F.lit(a), F.array(*own))))
        own = F.col(tokens)
        return df.withColumn(to, F.exists(own, lambda t: F.exists(F.coalesce(F.element_at(table, t), F.array().cast("array<array<string>>")), lambda r: F.forall(r, lambda x: F.array_contains(own, x)))))
    each = df.where(F.col(url).isNotNull()).select(F.col(url).alias("_u"), F.col(tokens).alias("_t")).groupBy("_u").agg(F.first("_t").alias("_t")).withColumn("anchor", F.explode("_t"))
    hit = each.join(rules.select("anchor", "antecedent"), "anchor").where(F.size(F.array_except("antecedent", "_t")) == 0).select("_u").distinct().withColumn(to, F.lit(True))
    return df.join(hit, F.col(url) == F.col("_u"), "left").drop("_u").withColumn(to, F.coalesce(to, F.lit(False)))


def filter_urls(df: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]], key: str = "page_id", url: str = "url", label_url: str = "url", label: str = "block", **mining) -> DataFrame:
    """``key, host, path, rule, verdict, mined`` for every row of ``df``.

    ``labelled`` holds URLs with a boolean (true: block).  Null URLs and those
    without ``://`` have an empty host and path and no tokens, so only the
    default ``allow`` fits them.  Repeated rows are judged one by one; ties
    between rules of one length go to the longer host.  Other columns play no
    part; an empty table gives an empty result.
    """
    def seen(d: DataFrame, column: str) -> DataFrame:
        d = d.withColumn("_host", url_host(F.col(column))).withColumn("_path", url_path(F.col(column)))
        return d.withColumn("_tokens", url_tokens(F.col(column), F.col("_host"), F.col("_path")))

    found = mine_rules(seen(labelled.select(F.col(label_url).alias("_url"), F.col(label).alias("_block")).where(F.col("_url").isNotNull()), "_url"), "_tokens", "_block", **mining)
    pages = seen(df.select(F.col(key).alias("_key"), F.col(url).alias("_url")), "_url")
    pages = with_listed(pages, rules, "_host", "_path", "_rule")
    judged = mined_block(pages, found, "_url", "_tokens", "_mined").withColumn("_mined", F.coalesce("_mined", F.lit(False)))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_mined"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(F.col("_key").alias(key), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), F.col("_mined").alias("mined"))
