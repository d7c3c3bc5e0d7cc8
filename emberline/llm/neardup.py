"""Near-duplicate groups by b-bit MinHash, exact after confirmation.

1. One pass hashes each text's word shingles and keeps the set's size and hash,
   band keys of its minima, and the low bits of the minima packed into longs.
2. Texts with equal sets collapse into one node, however many they are.  A node
   is named by a 64-bit hash of its set, which a second one is held against; other
   seeds are taken should two sets share the first only.
3. Nodes meet in band buckets.  In a bucket each node is paired with one hub,
   so a bucket of any size gives a number of pairs linear in it.
4. Pairs whose sizes and bit counts allow the similarity (corrected for chance
   collisions of b bits, with a margin of several standard deviations) are
   confirmed on full shingle sets, made anew for the few texts concerned.
5. Components of the confirmed links are formed.  Where a bucket still holds
   nodes of several components, bit counts tell in blocks of bounded size which
   nodes may be connected at all, and give a forest of such clusters.  Within a
   cluster all pairs across components that bit counts allow are compared on
   full sets, again in blocks; a block gives a forest of confirmed links, never
   all pairs.  Blocks are dealt so that nodes of the largest component, which are
   connected already, do not meet each other.  So every pair that shares a bucket is either compared or already
   connected, and no table grows with the square of a group.

With ``r`` rows in ``b`` bands a pair of similarity ``s`` misses every bucket
with probability ``(1 - s**r)**b``: 3e-6 at 0.8 with the defaults.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import among, cut, map_batches, spread_join, text_buffer
from .graph import components

BANDS, ROWS, BITS = 32, 5, 2
PERMUTATIONS = BANDS * ROWS
LONGS = PERMUTATIONS * BITS // 64
#: Standard deviations below the threshold at which a bit count still passes.
MARGIN = 5.0
#: Nodes compared at once by bit counts, 40 bytes each, and by full sets.
BLOCK = 2048
EXACT_BLOCK = 256

_RNG = np.random.default_rng(20240501)
_XOR = _RNG.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
_TIMES = _RNG.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, ascending, end to end, and their bounds.

    A-Z count as a-z.  A text of fewer than ``width`` words has its whole
    sequence as one shingle, a text without words has none.
    """
    data, offsets = text_buffer(texts)
    starts, ends, bounds = K.words(data, offsets)
    hashes = K.span_hashes(data, starts, ends, K.CODES_LOWER)
    own = K.grams(hashes, width)
    parts = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            parts.append(np.unique(own[a : b - width + 1]))
        elif b > a:
            parts.append(K.mix(K.grams(hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            parts.append(np.zeros(0, np.uint64))
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])


def minima(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The least value of each non-empty set under each permutation."""
    low = sets.astype(np.uint32)
    at = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(at), PERMUTATIONS), np.uint32)
    # in runs of sets whose values stay in the processor's cache
    for i in range(0, len(at), 64):
        j = min(len(at), i + 64)
        part = low[at[i] : at[j] if j < len(at) else len(low)]
        for k in range(PERMUTATIONS):
            out[i:j, k] = np.minimum.reduceat((part ^ _XOR[k]) * _TIMES[k], at[i:j] - at[i])
    return out


def bands(least: np.ndarray) -> np.ndarray:
    """One key per band, different for equal minima in other bands."""
    rows = least.astype(np.uint64).reshape(len(least), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * K.BASE
    for r in range(ROWS):
        key = K.mix(key * K.BASE + rows[:, :, r])
    return key.view(np.int64)


def signatures(least: np.ndarray) -> np.ndarray:
    """``BITS`` bits of each minimum, packed into longs."""
    bits = ((least * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint64)
    each = 64 // BITS
    shifts = (np.arange(each, dtype=np.uint64) * np.uint64(BITS))[None, None, :]
    return np.bitwise_or.reduce(bits.reshape(len(least), LONGS, each) << shifts, axis=2).view(np.int64)


def least_matches(threshold: float) -> int:
    """Equal minima that a pair at the threshold has, less the margin.

    A pair of similarity s matches with probability ``s + (1 - s) / 2**BITS``
    in each place, which is the correction for chance collisions.
    """
    chance = threshold + (1 - threshold) / 2**BITS
    return int(PERMUTATIONS * chance - MARGIN * (PERMUTATIONS * chance * (1 - chance)) ** 0.5)


def estimate(matches: np.ndarray | float) -> np.ndarray | float:
    """Similarity from the number of equal minima, corrected for chance collisions."""
    return (matches / PERMUTATIONS - 2.0**-BITS) / (1 - 2.0**-BITS)


_ODD = 0x5555555555555555


def matches(a: F.Column, b: F.Column) -> F.Column:
    """Equal minima of two signatures."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y).bitwiseOR(F.shiftrightunsigned(x.bitwiseXOR(y), 1)).bitwiseAND(F.lit(_ODD)))), F.lit(0), lambda s, x: s + x)
    return F.lit(PERMUTATIONS) - differ


def _set_hashes(sets: np.ndarray, bounds: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(sets ^ K.mix(np.full(1, seed, np.uint64))))])
    return K.mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def sketch(df: DataFrame, key: str, text: str, width: int, seed: int = 0) -> DataFrame:
    """``key, n_shingles, node, other, bands, sig``; all but the first two null for empty sets."""
    kind = df.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, bounds = shingle_sets(batch.column(1), width)
        size = np.diff(bounds)
        full = size > 0
        least = minima(sets, bounds)
        node, other = (pa.array(_set_hashes(sets, bounds, 2 * seed + k), mask=~full) for k in (0, 1))
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * x.shape[1])]), pa.int32()), x.ravel(), mask=pa.array(~full))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), node, other, lists(bands(least)), lists(signatures(least))], ["key", "n_shingles", "node", "other", "bands", "sig"])

    return map_batches(df.select(F.col(key).alias("key"), F.col(text).alias("_text")), "_text", work, f"key {kind}, n_shingles long, node long, other long, bands array<long>, sig array<long>")


def full_sets(df: DataFrame, text: str, width: int, seed: int = 0) -> DataFrame:
    """``node, shingles`` of each text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, bounds = shingle_sets(batch.column(0), width)
        return pa.RecordBatch.from_arrays([pa.array(_set_hashes(sets, bounds, 2 * seed)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), sets.view(np.int64))], ["node", "shingles"])

    return map_batches(df.select(F.col(text).alias("_text")), "_text", work, "node long, shingles array<long>")


def _matching(sig: np.ndarray, i: int) -> np.ndarray:
    """Equal minima of row ``i`` with each row after it."""
    x = sig[i + 1 :] ^ sig[i]
    return PERMUTATIONS - np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(_ODD)).sum(axis=1, dtype=np.int64)


def _pairs_across(size: np.ndarray, side: np.ndarray, sig: np.ndarray, label: np.ndarray, least: int, percent: int, confirm=None, matching=_matching) -> list[tuple[int, int]]:
    """Row pairs that join all labels of a block that are to be joined, at most one
    fewer than its rows.  A pair is to be joined if its sizes and bit counts
    allow the similarity and ``confirm(i, js)`` says so.  Side 0 is compared
    within, sides 1 and 2 with each other only.  ``label`` is changed."""
    out = []
    for i in range(len(sig) - 1):
        low, high = np.minimum(size[i], size[i + 1 :]), np.maximum(size[i], size[i + 1 :])
        ok = (label[i + 1 :] != label[i]) & (100 * low >= percent * high) & ((side[i] == 0) | (side[i + 1 :] != side[i]))
        if not ok.any():
            continue
        j = np.flatnonzero(ok & (matching(sig, i) >= least)) + i + 1
        if len(j) and confirm is not None:
            j = j[confirm(i, j)]
        for one in j[np.unique(label[j], return_index=True)[1]].tolist():
            out.append((i, one))
            label[label == label[one]] = label[i]
    return out


def _blocks(work):
    """``mapInArrow`` over rows sorted by ``bucket, i, j``: ``work(table)`` of each
    group, which may run over several batches, gives pairs of nodes."""
    keys = ("bucket", "i", "j")

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        at = np.stack([table[c].to_numpy() for c in keys])
        cuts = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1
        found = [x for a, b in zip([0, *cuts], [*cuts, table.num_rows], strict=True) if b - a > 1 for x in work(table.slice(a, b - a))]
        if found:
            a, b = (np.array(x, np.int64) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # all but the last group of the batch are complete
            at = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys])
            other = np.flatnonzero((at != at[:, -1:]).any(axis=0))
            first = int(other[-1]) + 1 if len(other) else 0
            if first or held and any(held[0].column(c)[0] != batch.column(c)[0] for c in keys):
                yield from done([*held, batch.slice(0, first)])
                held = []
            held.append(batch.slice(first))
        if held:
            yield from done(held)

    return run


def _rows(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Node, size, side, label and signature of a block's rows."""
    sig = table["sig"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, LONGS)
    return (*(table[c].to_numpy() for c in ("node", "n", "side")), table["component"].to_numpy().copy(), sig)


def candidate_blocks(least: int, percent: int):
    """Pairs that connect whatever a block's bit counts allow."""

    def work(table: pa.Table) -> list[tuple[int, int]]:
        node, size, side, label, sig = _rows(table)
        return [(node[i], node[j]) for i, j in _pairs_across(size, side, sig, label, least, percent)]

    return _blocks(work)


def exact_blocks(least: int, percent: int):
    """Pairs that connect what a block's full sets link."""

    def work(table: pa.Table) -> list[tuple[int, int]]:
        node, size, side, label, sig = _rows(table)
        if (label == label[0]).all():
            return []
        sets = table["shingles"].combine_chunks()
        values, inverse = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        bounds = np.concatenate([[0], np.cumsum(size)])
        mark = np.zeros(len(values), bool)

        def confirm(i: int, js: np.ndarray) -> np.ndarray:
            mark[inverse[bounds[i] : bounds[i + 1]]] = True
            both = np.array([np.count_nonzero(mark[inverse[bounds[j] : bounds[j + 1]]]) for j in js.tolist()], np.int64)
            mark[inverse[bounds[i] : bounds[i + 1]]] = False
            return 100 * both >= percent * (size[i] + size[js] - both)

        return [(node[i], node[j]) for i, j in _pairs_across(size, side, sig, label, least, percent, confirm)]

    return _blocks(work)


def open_buckets(known: DataFrame) -> DataFrame:
    """``bucket, giant, large, small, members`` of each bucket of ``known(bucket,
    node, component)`` that holds several components: the one with most nodes in
    it, how many it has, and how many the others have."""
    each = known.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    most = each.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("members")).where("members > most.n")
    return cut(most.select("bucket", F.col("most.component").alias("giant"), F.col("most.n").alias("large"), (F.col("members") - F.col("most.n")).alias("small"), "members"))


def in_blocks(known: DataFrame, open_: DataFrame, size: int) -> DataFrame:
    """Rows of the open buckets dealt into pairs ``i, j`` of blocks of about ``size``
    rows.  Blocks of the giant component are paired with the others' only."""
    few, many = (F.ceil(F.col(c) / size).cast("int") for c in ("small", "large"))
    others = F.col("component") != F.col("giant")
    place = F.pmod(F.xxhash64("node"), F.when(others, F.col("few")).otherwise(F.col("many"))).cast("int")
    return (
        spread_join(known, open_, "bucket", "members").withColumn("few", few).withColumn("many", many)
        .withColumn("mine", F.when(others, place).otherwise(place + F.col("few")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("few") - 1 + F.when(others, F.col("many")).otherwise(F.lit(0)))))
        .select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"), "node", "component")
    )


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row of ``df``.

    Rows are linked where ``100 * intersection >= percent * union`` of their
    shingle sets; ``component_id`` is the least key reachable and ``kept``
    says that it is the row's own.  Null, empty and word-free texts have no
    shingles and are linked with nothing.  Rows that repeat a key with one text
    are one document; ties of the least key cannot matter, as equal keys are one.
    A null key is never the least of several.  Other columns play no part; an empty table gives an
    empty result.
    """
    least = least_matches(percent / 100)
    for seed in range(100):
        rows = cut(sketch(df, key, text, width, seed)).withColumn("row", F.monotonically_increasing_id())
        if not rows.groupBy("node").agg(F.min("other").alias("x"), F.max("other").alias("y")).where("x <> y").limit(1).count():
            break
    same = rows.where("node is not null").groupBy("node").agg(F.min("row").alias("row"), F.min("key").alias("least_key"))
    nodes = cut(rows.join(same.select("row"), "row", "left_semi").select("node", F.col("n_shingles").alias("n"), "bands", "sig", "key"))
    each = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = cut(each.groupBy("bucket").agg(F.count("*").alias("members"), F.min("node").alias("hub")).where("members > 1"))
    members = cut(spread_join(each, shared, "bucket", "members"))
    facts = nodes.select("node", "n", "sig")
    fits = lambda n, m: F.least(n, m) * 100 >= percent * F.greatest(n, m)

    def sets_of(some: DataFrame) -> DataFrame:
        """``node, shingles`` of the nodes, made anew from their texts."""
        some = some.distinct()
        keys = nodes.select("node", "key").join(some, "node", "left_semi").select(F.col("key").alias("_key")).distinct()
        keys = cut(keys)
        return cut(full_sets(_semi(df, key, text, keys), "_text", width, seed).join(some, "node", "left_semi").dropDuplicates(["node"]))

    def confirm(pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b`` whose full sets are alike enough."""
        pairs = cut(pairs)
        sets = sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))))
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")

    a, b = (facts.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}")) for x in "ab")
    stars = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = cut(confirm(stars.join(b, "b").join(a, "a").where(fits(F.col("na"), F.col("nb")) & (matches(F.col("sa"), F.col("sb")) >= least)).select("a", "b")))
    groups = components(links)

    # buckets that still hold several components: which of their nodes bit counts would connect
    known = cut(members.where("members > 2").select("bucket", "node").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")))
    sent = in_blocks(known, open_buckets(known), BLOCK).join(facts, "node")
    sorted_ = sent.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    maybe = cut(sorted_.mapInArrow(candidate_blocks(least, percent), "a long, b long").distinct())
    if maybe.limit(1).count():
        # in each cluster of them all pairs across components are compared on full sets
        clusters = cut(components(links.union(maybe)).select("node", F.col("component").alias("bucket")).join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")))
        several = open_buckets(clusters)
        dealt = spread_join(clusters, several, "bucket", "members")
        sets = sets_of(dealt.select("node"))
        sent = in_blocks(clusters, several, EXACT_BLOCK).join(facts, "node").join(sets, "node")
        sorted_ = sent.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        further = cut(sorted_.mapInArrow(exact_blocks(least, percent), "a long, b long").distinct())
        groups = components(links.union(further))

    # back to rows: a node's copies share its component
    of = same.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = of.groupBy("component").agg(F.min("least_key").alias("component_id"))
    final = of.join(first, "component").select("node", "component_id")
    out = rows.join(final, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id")))
    return out.select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def _semi(df: DataFrame, key: str, text: str, keys: DataFrame) -> DataFrame:
    """The texts whose key is among ``keys``, which is read twice."""
    docs = among(df.select(F.col(key).alias("_k"), F.col(text).alias("_text")), keys.withColumnRenamed("_key", "_k"), "_k")
    return docs.join(keys, F.col("_k").eqNullSafe(F.col("_key")), "left_semi").select("_text")
