"""Spelling variants: words one edit apart, found in forward and reversed sorted dictionaries.

One inserted, deleted or replaced code point leaves the first or the second
half of a word intact.  Words that share a first half lie next to each other
in the sorted dictionary, words that share a second half in the dictionary of
reversed words; both are dealt into ranges and scanned block by block.  A block
of too many words is subdivided in the same way: of the stretch where its words
may still differ, one half or the other is intact.  After the stretch is one
code point long, a block can hold no more words than the alphabet allows.

Two words of lengths ``n`` and ``n`` or ``n + 1`` meet in blocks of ``n``.  A
pair's place is the length of its common prefix; only the block whose stretch
holds this place reports it, so each pair is counted once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import Folder, cut

# Fixed value: what counts as a run of letters.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Words of a block that one task scans; of a block that is compared pair by pair.
BLOCK, SMALL = 2_000, 8
#: Words counted together before they are given on.
MOST_COUNTED = 300_000


def word_counts(df: DataFrame, ident: str = "doc_id", text: str = "text", every: int = 199, shortest: int = 6, least: int = 5) -> DataFrame:
    """``word, n``: lower-cased letter runs of all texts (A-Z only are lowered), where one
    run in ``every`` of a text, by a checksum, has lost a code point; words of
    ``shortest`` code points and ``least`` occurrences.  A null ``ident`` counts as empty."""
    rows = df.select(F.coalesce(F.col(f"`{ident}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{text}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not t:
                    continue
                head = zlib.crc32(f"{i}:".encode())
                for word, n in Counter(RUN.findall(t.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), head)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= shortest:
                        total[word] += n
            if len(total) >= MOST_COUNTED:
                yield given()
                total.clear()
        if total:
            yield given()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def place(short: str, other: str, lo: int, hi: int) -> int:
    """Length of the common prefix of two near words if it lies in the stretch, else -1."""
    n, i = len(short), lo
    while i < hi and short[i] == other[i]:
        i += 1
    if len(other) == n:
        return i if i < hi and short[i + 1 :] == other[i + 1 :] else -1
    return i if (i < hi or i == n) and short[i:] == other[i + 1 :] else -1


def near_pairs(words: list[str], n: int, lo: int, hi: int) -> Iterator[tuple[str, str]]:
    """Near pairs of a block whose words, of ``n`` or ``n + 1`` code points, agree outside the stretch ``lo`` to ``hi``."""
    if len(words) > SMALL and hi - lo > 1:
        mid = (lo + hi) // 2
        for a, b in ((mid, hi), (lo, mid)):
            blocks: dict[str, list[str]] = {}
            for w in words:
                end = len(w) - n
                blocks.setdefault(w[lo:mid] if a == mid else w[end + mid : end + hi], []).append(w)
            for block in blocks.values():
                if len(block) > 1:
                    yield from near_pairs(block, n, a, b)
        return
    shorts, longs = [w for w in words if len(w) == n], [w for w in words if len(w) != n]
    for x, a in enumerate(shorts):
        for b in shorts[x + 1 :]:
            if place(a, b, lo, hi) >= 0:
                yield a, b
        for b in longs:
            if place(a, b, lo, hi) >= 0:
                yield a, b


def halves(rows: DataFrame) -> DataFrame:
    """Rows ``word, n, size, lo, hi`` with the stretch ``lo`` to ``hi`` halved, twice as many: to the right of
    the middle, where blocks are ranges of the sorted dictionary, and to the left, where they are ranges of reversed words."""
    mid = "cast(floor((lo + hi) / 2) as int)"
    parts = rows.select("word", "n", "size", F.explode(F.expr(f"array(struct({mid} as lo, hi), struct(lo, {mid} as hi))")).alias("p")).select("word", "n", "size", "p.*")
    # the intact parts: up to the stretch, and after it, the latter from its end
    head, tail = F.expr("substring(word, 1, lo)"), F.expr("reverse(right(word, size - hi))")
    return parts.select("word", "n", "size", "lo", "hi", head.alias("head"), tail.alias("tail"), F.xxhash64("size", "lo", "hi", head, tail).alias("key"))


def blocks(words: DataFrame, folder: Folder, most: int = BLOCK) -> DataFrame:
    """All words of ``words(word, n)`` in their blocks, those of more than ``most`` words subdivided."""
    length = F.length("word")
    rows = halves(words.select("word", "n", F.explode(F.array(length, length - 1)).alias("size")).select("word", "n", "size", F.lit(0).alias("lo"), F.col("size").alias("hi")))
    kept = None
    while True:
        heavy = folder.stored(rows.groupBy("key").agg(F.count("*").alias("c"), F.max(F.expr("hi - lo")).alias("w")).where((F.col("c") > most) & (F.col("w") > 1)).select("key"))
        some = heavy.limit(common.FEW + 1).count()
        if not some:
            return rows if kept is None else kept.unionByName(rows)
        # a long for each such block; more of them than this are joined instead
        sent = F.broadcast(heavy) if some <= common.FEW else heavy
        light = rows.join(sent, "key", "left_anti")
        kept = light if kept is None else kept.unionByName(light)
        rows = folder.stored(halves(rows.join(sent, "key", "left_semi").where("hi - lo > 1").select("word", "n", "size", "lo", "hi")))


def near_words(words: DataFrame, folder: Folder, most: int = BLOCK) -> DataFrame:
    """``word, n_near, best_n, best`` of ``words(word, n)``: how many near words each has, and that of largest ``n``, least among equals."""
    order = ["size", "lo", "hi", "head", "tail"]
    ranges = blocks(words, folder, most).select(*order, "word", "n").repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), *(pa.array([v[c] for v in found.values()], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.string())))], ["word", "c", "best_n", "best"]
            )

        def count(word: str, other: str, n: int) -> None:
            held = found.get(word)
            if held is None:
                found[word] = [1, n, other]
                return
            held[0] += 1
            if n > held[1] or n == held[1] and other < held[2]:
                held[1:] = n, other

        def scan(at: tuple, block: dict[str, int]) -> None:
            for a, b in near_pairs(list(block), *at[:3]):
                count(a, b, block[b])
                count(b, a, block[a])

        at, block = None, {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(batch.num_columns)]
            for *key, word, n in zip(*columns, strict=True):
                if key != at:
                    if len(block) > 1:
                        scan(at, block)
                    at, block = key, {}
                block[word] = n
            if len(found) >= MOST_COUNTED:
                yield given()
                found.clear()
        if len(block) > 1:
            scan(at, block)
        if found:
            yield given()

    best = F.min(F.struct((-F.col("best_n")).alias("b"), "best"))
    return ranges.mapInArrow(run, "word string, c long, best_n long, best string").groupBy("word").agg(F.sum("c").alias("n_near"), best.alias("m")).select("word", "n_near", (-F.col("m.b")).alias("best_n"), "m.best")


def last_forms(links: DataFrame, folder: Folder) -> DataFrame:
    """``word, root`` of ``links(word, form)``: the last word reached from each, by doubling the steps; links have no cycles."""
    roots = folder.stored(links.select("word", F.col("form").alias("root")))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = folder.stored(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"))
        roots = after.select("word", "root")
        if after.where("further IS NOT NULL").limit(1).count() == 0:
            return roots


def spelling_variants(df: DataFrame, ident: str = "doc_id", text: str = "text", every: int = 199, shortest: int = 6, least: int = 5, ratio: int = 5, block: int = BLOCK) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all words of the texts (see ``word_counts``).

    A word's form is its near word of largest ``n``, if that is ``ratio`` times
    its own or more, else null; its root is where forms end.  Null and empty
    texts hold no words; repeated rows count again; an empty table gives an
    empty result; other columns are not read.
    """
    folder = Folder(df.sparkSession)
    words = folder.stored(word_counts(df, ident, text, every, shortest, least))
    near = folder.stored(near_words(words, folder, block))
    joined = words.join(near, "word", "left").withColumn("form", F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best")))
    joined = folder.stored(joined)
    roots = last_forms(joined.where("form IS NOT NULL").select("word", "form"), folder)
    out = joined.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n")
    )
    out = cut(out)
    folder.remove()
    return out
