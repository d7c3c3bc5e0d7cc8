"""Removing repeated substrings, exactly, by suffix arrays over what can repeat.

1. One pass cuts each text's starts of ``length``-byte strings into runs by
   winnowing: all starts of a run choose the same anchor, and equal strings
   choose equal anchors.  A run's starts are cut further by their distance to
   the anchor, so that each part has a long core in common.  Rows hold hashes of
   anchors, of cores and of segments, the bytes that a part's strings cover, not
   the bytes themselves.
2. Runs whose anchor is found once cannot repeat, nor can parts whose core is.
   Equal segments collapse to one; if a segment is found twice, all its strings
   are repeated.
3. Bytes are fetched for one text of each segment left, only where a core has
   different segments and one of them is not settled: those before and after the
   core, as one symbol stands for the core that all strings of a part hold whole.
   Segments go to shards by core, so equal strings meet; each shard's suffix array
   and common prefixes tell the repeated starts.  A core with more segments than a shard holds is
   split: parts get suffix arrays of their own, and each pair of parts is merged
   by binary search of one's strings in the other's array.
4. Repeated starts go back to the runs, runs to their texts, and the covered
   bytes are cut out of the texts concerned.

Copies of a whole text are told by its hash beforehand, which is held against its
SHA-256: nothing needs to be matched to know that all their strings are repeated.  Segments are told by
two 64-bit hashes, the core's and their own, cores by two of their bytes.

The same steps over words find passages that documents share: there a symbol is
a word, and a string counts if another document holds it too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from . import winnow
from .common import Folder, among, cut, map_batches, pieces, shuffle_partitions, slices, spread_join, text_buffer
from .suffixes import MOST, alike, search

GRAM = 128
#: Parts that a run's starts are cut into, at most.
PARTS = 4
#: Segments in a part of a core's group.
PART = 2800
#: Segments in a shard, about, and symbols in one suffix array where groups share it.
SHARD = 16_000
TOGETHER = 700_000
#: Bytes of texts that segments are cut from together, about, and segments cut at once.
FETCH, CUTS = 1_000_000, 20_000
#: Codes of bytes for the second hash of a core.
CODES = K.CODES[::-1].copy()
#: Words of a passage, at least, and of its anchor.
PASSAGE, WORD_GRAM = 50, 18


@dataclass(frozen=True)
class Strings:
    """What is compared: strings of ``length`` bytes or, with ``words``, words."""

    length: int
    gram: int
    words: bool = False

    @property
    def width(self) -> int:
        """Bytes that a fetched symbol takes."""
        return 8 if self.words else 1

    @property
    def reach(self) -> int:
        """Starts of a part, at most; the rest of ``length`` is its core."""
        return winnow.reach(self.length, self.gram, PARTS)

    @property
    def part(self) -> int:
        """Segments in a part, so that two parts' symbols fit in a suffix array."""
        return max(1, min(PART, MOST // (4 * self.reach)))

    def symbols(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts end to end and the texts' bounds."""
        data, offsets = text_buffer(texts)
        if not self.words:
            return data, offsets
        starts, ends, bounds = K.words(data, offsets)
        return K.span_hashes(data, starts, ends), bounds


def find_runs(texts: DataFrame, strings: Strings) -> DataFrame:
    """``anchor, content, spot, low, high, hashes`` of ``texts(content, text)``: a row
    for each run, with the hashes of its parts' cores, then of their segments."""
    length, gram = strings.length, strings.gram

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        data, offsets = strings.symbols(batch.column(1))
        text, low, high, anchor, hashed = winnow.runs(data, offsets, length, gram)
        if not len(text):
            return None
        base = offsets[text]
        run, number, first, last, begin, end = winnow.cores(low, high, anchor, length, gram, PARTS)
        segment = K.span_hashes(data, base[run] + first, base[run] + last + length) + (anchor[run] - first).astype(np.uint64) * K.BASE
        # a core may begin before that of the run before
        order = np.argsort(base[run] + begin, kind="stable")
        core = np.empty(len(run), np.uint64)
        core[order] = K.span_hashes(data, (base[run] + begin)[order], (base[run] + end)[order])
        core = K.mix(core + number.astype(np.uint64) * K.BASE)
        count = np.bincount(run, minlength=len(text))
        bounds = np.concatenate([[0], np.cumsum(2 * count)])
        place = np.arange(len(run)) + (np.cumsum(count) - count)[run]
        hashes = np.empty(2 * len(run), np.uint64)
        hashes[place], hashes[place + count[run]] = core, K.mix(segment)
        columns = [hashed.view(np.int64), batch.column(0).to_numpy(zero_copy_only=False)[text], anchor, low, high]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.view(np.int64)))], ["anchor", "content", "spot", "low", "high", "hashes"])

    return map_batches(texts.select("content", "text"), "text", work, "anchor long, content long, spot long, low long, high long, hashes array<long>", 1_000_000)


def parted(runs: DataFrame, strings: Strings) -> DataFrame:
    """``core, segment, content, low, high, lead`` of each run's parts, as :func:`winnow.cores`
    cuts them; the core begins ``lead`` after the first start."""
    step = F.lit(strings.reach)
    half = (F.size("hashes") / 2).cast("int")
    each = runs.withColumn("k", F.explode(F.sequence(F.lit(0), half - 1)))
    begin = F.col("spot") - (F.floor((F.col("spot") - F.col("low")) / step) - F.col("k")) * step
    low = F.greatest(F.col("low"), begin - step + 1).cast("long")
    return each.select(
        F.get("hashes", F.col("k")).alias("core"), F.get("hashes", half + F.col("k")).alias("segment"), "content",
        low.alias("low"), F.least(F.col("high"), begin).cast("long").alias("high"), (begin - low).cast("int").alias("lead"),
    )


def _ranges(hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of true as first and last index."""
    step = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [{"low": a, "high": b - 1} for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)]


_RANGES = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))


def match_shard(table: pa.Table, strings: Strings) -> pa.Table:
    """``core, segment, ranges``: the repeated starts of a shard's unsettled segments."""
    length, width = strings.reach + 1, strings.width
    order = np.lexsort((table["segment"].to_numpy(), table["side"].to_numpy(), table["core"].to_numpy()))
    core, segment, side = (table[c].to_numpy()[order] for c in ("core", "segment", "side"))
    one = np.ones(len(order), bool)
    one[1:] = (segment[1:] != segment[:-1]) | (core[1:] != core[:-1]) | (side[1:] != side[:-1])
    order, core, segment, side = (x[one] for x in (order, core, segment, side))
    settled = table["settled"].to_numpy()[order]
    # a settled segment has a partner for any document
    label = np.where(settled, segment, table["label"].to_numpy()[order])
    # equal cores have one number
    check, lead = table["check"].to_numpy()[order], table["lead"].to_numpy()[order].astype(np.int64)
    by_core = np.lexsort((check, core))
    number = np.empty(len(order), np.int64)
    number[by_core] = np.cumsum(np.append(0, (np.diff(core[by_core]) != 0) | (np.diff(check[by_core]) != 0))[: len(order)])
    data = table["bytes"].combine_chunks().take(pa.array(order))
    size = pa.compute.binary_length(data).to_numpy().astype(np.int64) // width + 1
    out: tuple[list, list, list] = ([], [], [])

    def symbols(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        own = np.frombuffer(b"".join(data.slice(a, b - a).to_pylist()), np.uint64 if strings.words else np.uint8)
        if strings.words:
            own = np.unique(own, return_inverse=True)[1]
        # each segment's core, between what is before and after it
        bounds = np.concatenate([[0], np.cumsum(size[a:b])])
        at = bounds[:-1] + lead[a:b]
        both = np.empty(bounds[-1], np.int64)
        held = np.ones(bounds[-1], bool)
        held[at] = False
        both[held] = own
        both[at] = number[a:b] - number[a:b].min() + (int(own.max(initial=0)) + 1 if strings.words else 256)
        return both, bounds

    def labels(a: int, bounds: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return label[a + np.searchsorted(bounds, starts, side="right") - 1] if strings.words else starts

    def tell(a: int, b: int, bounds: np.ndarray, starts: np.ndarray) -> None:
        hit = np.zeros(bounds[-1], bool)
        hit[starts] = True
        for i in range(a, b):
            part = hit[bounds[i - a] : bounds[i - a + 1]]
            if not settled[i] and part.any():
                for column, value in zip(out, (int(core[i]), int(segment[i]), _ranges(part)), strict=True):
                    column.append(value)

    def within(a: int, b: int) -> None:
        own, bounds = symbols(a, b)
        starts, number = alike(own, bounds, length)
        if not len(starts):
            return
        mine, first = labels(a, bounds, starts), np.flatnonzero(np.diff(number, prepend=-1))
        several = np.minimum.reduceat(mine, first) != np.maximum.reduceat(mine, first)
        tell(a, b, bounds, starts[np.repeat(several, np.diff(np.append(first, len(starts))))])

    def between(a: int, middle: int, b: int) -> None:
        """Strings of side 2, looked up in the suffix array of side 1."""
        both, bounds = symbols(a, b)
        half = bounds[middle - a]
        x, y, x_bounds, y_bounds = both[:half], both[half:], bounds[: middle - a + 1], bounds[middle - a :] - half
        starts, number = alike(x, x_bounds, length)
        queries = np.flatnonzero(np.arange(len(y)) + length <= np.repeat(y_bounds[1:], np.diff(y_bounds)))
        if not len(starts):
            return
        found = search(x, starts, y, queries, length)
        queries, found = queries[found >= 0], found[found >= 0]
        low = np.minimum.reduceat(labels(a, x_bounds, starts), np.flatnonzero(np.diff(number, prepend=-1)))
        high = np.maximum.reduceat(labels(a, x_bounds, starts), np.flatnonzero(np.diff(number, prepend=-1)))
        mine = labels(middle, y_bounds, queries) if strings.words else queries + half
        np.minimum.at(low, number[found], mine)
        np.maximum.at(high, number[found], mine)
        tell(a, middle, x_bounds, starts[(low != high)[number]])
        tell(middle, b, y_bounds, queries[(low != high)[number[found]]])

    groups = np.append(np.flatnonzero(np.append(True, core[1:] != core[:-1])), len(core))
    total = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < len(groups) - 1:
        a, b = groups[at], groups[at + 1]
        if side[a] == 1 or side[b - 1] == 2:
            middle = a + int(np.searchsorted(side[a:b], 2))
            if a < middle < b:
                between(a, middle, b)
            at += 1
            continue
        # as many whole groups as one suffix array holds
        to = at + 1
        while to < len(groups) - 1 and side[groups[to]] == 0 and total[groups[to + 1]] - total[a] <= TOGETHER:
            to += 1
        if groups[to] - a > 1:
            within(a, groups[to])
        at = to
    return pa.table({"core": pa.array(out[0], pa.int64()), "segment": pa.array(out[1], pa.int64()), "ranges": pa.array(out[2], _RANGES)})


def repeated_starts(texts: DataFrame, strings: Strings, folder: Folder, runs: DataFrame | None = None) -> DataFrame:
    """``content, spans``: ascending spans ``low, high`` of each text that repeated
    strings cover, in symbols, high exclusive, possibly touching or overlapping.

    ``texts(content, text)`` may hold a text several times; it counts once.
    ``runs`` are those of :func:`find_runs`, if there are some already; tables in
    between go to ``folder``, which must outlive the result.
    """
    runs = folder.stored(find_runs(texts, strings)) if runs is None else runs
    spot = lambda place: F.xxhash64("content") if strings.words else F.xxhash64("content", place)
    several = lambda place: (F.min(spot(place)).alias("x"), F.max(spot(place)).alias("y"))
    shared = cut(runs.groupBy("anchor").agg(*several("spot"), F.count("*").alias("rows")).where("x <> y").select("anchor", "rows"))
    # written first, so that a join can split what one core has
    parts = folder.stored(parted(spread_join(runs, shared, "anchor", "rows"), strings))
    # the first row's content and place, as all of one aggregation see the same rows
    one = ("content", "low", "high", "lead")
    found_at = parts.groupBy("core", "segment").agg(*several("low"), *(F.first(c).alias(c) for c in one))
    segments = folder.stored(found_at.select("core", "segment", (F.col("x") != F.col("y")).alias("settled"), *one))
    groups = cut(segments.groupBy("core").agg(F.count("*").alias("different"), F.min("settled").alias("all")).where("different > 1 and not all").select("core", "different"))
    wanted = folder.stored(spread_join(segments, groups, "core", "different").select("core", "segment", "different", "settled", *one))
    n = pieces(wanted.count(), SHARD, most=1 << 30)

    # the symbols of one text of each segment
    by_text = wanted.groupBy("content").agg(F.collect_list(F.struct("core", "segment", "different", "settled", "lead", "low", "high")).alias("cuts"))
    holders = among(texts.select("content", "text"), wanted.select("content"), "content")
    length = strings.length

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for batch in batches for p in slices(batch, "text", FETCH)):
            data, offsets = strings.symbols(piece.column(2))
            codes = K.mix(data) if strings.words else data
            count = pa.compute.list_value_length(piece.column(0)).to_numpy()
            texts_of, every = np.repeat(np.arange(piece.num_rows), count), piece.column(0).flatten()
            for at in range(0, len(every), CUTS):
                cuts, text = every.slice(at, CUTS), texts_of[at : at + CUTS]
                lead, low, high = (cuts.field(k).to_numpy().astype(np.int64) for k in (4, 5, 6))
                first, end = offsets[text] + low, offsets[text] + high + length
                begin = first + lead
                close = begin + length - strings.reach
                order = np.argsort(begin, kind="stable")
                check = np.empty(len(begin), np.uint64)
                check[order] = K.span_hashes(codes, begin[order], close[order], CODES)
                # the symbols from first to begin and from close to end
                sides = np.stack([lead, end - close], 1).ravel()
                shift = np.stack([first, close], 1).ravel() - (np.cumsum(sides) - sides)
                own = data[np.arange(sides.sum()) + np.repeat(shift, sides)]
                bounds = np.concatenate([[0], np.cumsum((lead + end - close) * strings.width)]).astype(np.int32)
                held = pa.Array.from_buffers(pa.binary(), len(lead), [None, pa.py_buffer(bounds), pa.py_buffer(own)])
                yield pa.RecordBatch.from_arrays([*(cuts.field(k) for k in range(5)), piece.column(1).take(pa.array(text)), pa.array(check.view(np.int64)), held], ["core", "segment", "different", "settled", "lead", "label", "check", "bytes"])

    fetched = holders.join(by_text, "content").select("cuts", F.xxhash64("content").alias("label"), "text").mapInArrow(fetch, "core long, segment long, different long, settled boolean, lead int, label long, check long, bytes binary")
    mine = F.pmod(F.xxhash64("segment"), F.col("parts")).cast("int")
    sent = (
        fetched.withColumn("parts", F.ceil(F.col("different") / strings.part).cast("int")).withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            F.when(F.col("parts") > 1, F.col("core")).otherwise(F.pmod("core", F.lit(n))).alias("shard"),
            F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
            F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"),
            "core", "segment", "settled", "lead", "label", "check", "bytes",
        )
    )
    # little is sent for the work that it makes: as many tasks as partitions, not as few as bytes ask for
    sent = sent.repartition(shuffle_partitions(texts.sparkSession), "shard", "i", "j")
    matched = sent.groupBy("shard", "i", "j").applyInArrow(lambda t: match_shard(t, strings), "core long, segment long, ranges array<struct<low:long,high:long>>")
    whole = segments.where("settled").select("core", "segment", F.array(F.struct(F.lit(0).cast("long").alias("low"), (F.col("high") - F.col("low")).alias("high"))).alias("ranges"))
    found = folder.stored(matched.union(whole))
    back = parts.join(found, ["core", "segment"]).select("content", F.explode(F.transform("ranges", lambda r: F.struct((F.col("low") + r["low"]).alias("low"), (F.col("low") + r["high"] + length).alias("high")))).alias("s"))
    return back.groupBy("content").agg(F.array_sort(F.collect_set("s")).alias("spans"))


def _merged(spans: list[dict[str, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans:
        if out and s["low"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["high"]))
        else:
            out.append((s["low"], s["high"]))
    return out


def with_content(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``key, content, n_bytes, text`` of all rows, and ``key, content, n_bytes, sha`` at hand.

    ``content`` is a 64-bit hash of the text, null being empty.  It is held against
    SHA-256; should two texts share one, another hash is taken, so equal contents
    are equal texts.
    """
    for seed in range(100):
        whole = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        texts = whole.select("key", F.xxhash64(F.lit(seed), "text").alias("content"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
        facts = cut(texts.select("key", "content", "n_bytes", F.sha2("text", 256).alias("sha")))
        other = F.xxhash64("sha")
        if not facts.groupBy("content").agg(F.min(other).alias("x"), F.max(other).alias("y")).where("x <> y").limit(1).count():
            return texts, facts
    raise RuntimeError("no hash tells the texts apart")


def passages(texts: DataFrame, copied: DataFrame, folder: Folder, length: int = PASSAGE, gram: int = WORD_GRAM) -> DataFrame:
    """``content, passages`` of the texts that share ``length`` words or more with
    another one or that are ``copied``: spans of word numbers, high exclusive.
    Tables in between go to ``folder``, which must outlive the result.

    Words are ``[^\\x20\\x09-\\x0D]+``, so a passage may be spaced otherwise.
    """
    strings = Strings(length, gram, words=True)
    runs = folder.stored(find_runs(texts, strings))
    # a text's last start tells how many words it has
    entire = runs.join(copied, "content", "left_semi").groupBy("content").agg((F.max("high") + length).alias("high"))
    entire = entire.select("content", F.array(F.struct(F.lit(0).cast("long").alias("low"), "high")).alias("spans"))
    some = repeated_starts(texts, strings, folder, runs).join(copied, "content", "left_anti")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = [[{"low": a, "high": b} for a, b in _merged(s)] for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(merged, _RANGES)], ["content", "passages"])

    return some.unionByName(entire).mapInArrow(merge, "content long, passages array<struct<low:long,high:long>>")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, gram: int = GRAM, words: int = PASSAGE, word_gram: int = WORD_GRAM) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256, n_passages,
    n_passage_words, removed, passages`` for every row.

    A byte goes if a ``length``-byte string over it also starts anywhere else
    in the table, in the same text too; ``removed`` lists the byte spans that
    go.  ``passages`` lists the spans of words inside ``words`` successive ones that
    another row has too, whatever their bytes: they are told, not removed.
    ``length`` and ``words`` are above their grams and at most half a million.
    Null and empty texts have no bytes.  Repeated rows are copies of each other; ties cannot
    arise, as all places of a string count alike.  Other columns play no part; an
    empty table gives an empty result.
    """
    kind = df.schema[key].dataType.simpleString()
    texts, facts = with_content(df, key, text)
    several = cut(facts.where("n_bytes > 0").groupBy("content").agg(F.count("*").alias("copies")).where("copies > 1").select("content", F.lit(True).alias("copied")))
    long = texts.where(F.col("n_bytes") >= length).select("content", "text")
    folder = Folder(df.sparkSession)
    spans = folder.stored(repeated_starts(long, Strings(length, gram), folder).join(several, "content", "left_anti"))
    nothing = hashlib.sha256(b"").hexdigest()

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = t.encode()
                gone, at, kept = _merged(s), 0, hashlib.sha256()
                for a, b in gone:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                for column, value in zip(out, (sum(b - a for a, b in gone), len(gone), kept.hexdigest(), [{"low": a, "high": b} for a, b in gone]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2]), pa.array(out[3], _RANGES)], ["content", "n_removed", "n_spans", "kept_sha256", "removed"])

    touched = among(long, spans, "content").join(spans, "content").select("content", "text", "spans")
    stripped = cut(touched.mapInArrow(strip, "content long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<low:long,high:long>>"))
    # the tables of bytes go before those of words come
    folder.remove()
    folder = Folder(df.sparkSession)
    # shorter texts have fewer words than a passage
    told = cut(passages(texts.where(F.col("n_bytes") >= 2 * words - 1).select("content", "text"), several, folder, words, word_gram))
    folder.remove()
    copied = F.coalesce("copied", F.lit(False)) & (F.col("n_bytes") >= length)
    none = F.array().cast("array<struct<low:long,high:long>>")
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("n_bytes").alias("high")))
    zero = F.lit(0).cast("long")
    return facts.join(several, "content", "left").join(stripped, "content", "left").join(told, "content", "left").select(
        F.col("key").cast(kind).alias(key), "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(copied, zero + 1).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(copied, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.coalesce(F.size("passages"), F.lit(0)).cast("long").alias("n_passages"),
        F.aggregate(F.coalesce("passages", none), zero, lambda n, s: n + s["high"] - s["low"]).alias("n_passage_words"),
        F.when(copied, all_of).otherwise(F.coalesce("removed", none)).alias("removed"), F.coalesce("passages", none).alias("passages"),
    )
