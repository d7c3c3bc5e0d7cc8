"""Document fingerprints by randomised edit embedding.

A walk over a text's characters emits the character under it at every step and
then moves on or stays by a random bit shared by all texts, a function of the
step and the character.  Two walks that have lost their common position meet
again after an edit, so texts a few edits apart emit sequences that differ in
few places: edit distance becomes Hamming distance.  A fingerprint samples bits
of the emitted sequence; the sampled places are the least of shared random
priorities, so they rarely move when the length changes a little.

Walks of many texts run in lockstep in numpy, the last few long ones alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import among, bit_likeness, cut, map_batches, pieces, shuffle_partitions, slices, split_among
from .graph import components
from .neardup import BLOCK, _blocks, _pairs_across, in_blocks, open_buckets

BITS = 512
PERIOD = 4096
END = 255
CHUNK = 64
#: Walks run in lockstep while there are as many as this.
TOGETHER = 24
#: Documents that follow each other in one piece of the table, about.
PIECE_ROWS = 2000
#: Of Zstandard; higher ones take longer and save less than one part in a hundred.
LEVEL = 5

_RNG = np.random.default_rng(77003)
_MOVES = _RNG.integers(0, 2, (PERIOD, 256), dtype=np.uint8)
_MOVES[:, END] = 0
_MOVE_ROWS = [row.tobytes() for row in _MOVES]
_SIGN = _RNG.integers(0, 2, (BITS, 256), dtype=np.uint8)


def _records() -> list[np.ndarray]:
    """For each bit the steps (from 1) that are first to hold its least priority
    so far.  Given one at ``n``, the next is beyond ``m`` with probability
    ``n / m``, which is drawn directly, up to lengths that no text has."""
    out = []
    for _ in range(BITS):
        own = [1]
        while own[-1] < 1 << 40:
            own.append(int(own[-1] / (1.0 - _RNG.random())) + 1)
        out.append(np.array(own, np.int64))
    return out


_RECORDS = _records()
_PLACES = np.unique(np.concatenate(_RECORDS)) - 1


def classes(text: str) -> np.ndarray:
    """Characters as classes 0..254."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((points * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16) % END


def embed(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Steps that each text's whole walk takes, and what it emits at the sampled
    places (texts by places up to the longest walk; :data:`END` beyond the end)."""
    n = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    flat = np.full(int(size.sum()) + n, END, np.uint8)
    begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    for t, b in zip(texts, begin.tolist(), strict=True):
        flat[b : b + len(t)] = t
    steps = np.zeros(n, np.int64)
    # a walk takes about two steps a character
    seen = np.full((n, int(np.searchsorted(_PLACES, 2 * int(size.max(initial=0)) + 256))), END, np.uint8)
    active = np.flatnonzero(size)
    pos = begin[active]
    at = 0
    while len(active) >= TOGETHER:
        emitted = np.empty((CHUNK, len(active)), np.uint8)
        for i in range(CHUNK):
            c = emitted[i]
            np.take(flat, pos, out=c, mode="clip")
            pos += _MOVES[(at + i) % PERIOD].take(c)
        alive = emitted != END
        steps[active] += alive.sum(axis=0)
        lo, hi = np.searchsorted(_PLACES, [at, at + CHUNK])
        if hi > seen.shape[1]:
            seen = np.concatenate([seen, np.full((n, hi), END, np.uint8)], axis=1)
        if hi > lo:
            seen[active, lo:hi] = emitted[_PLACES[lo:hi] - at].T
        at += CHUNK
        if not alive[-1].all():
            on = flat[pos] != END
            active, pos = active[on], pos[on]
    period = PERIOD - 1
    for i, p in zip(active.tolist(), pos.tolist(), strict=True):
        text = flat[begin[i] : begin[i] + size[i] + 1].tobytes()
        p -= int(begin[i])
        out, j, end = bytearray(), at, int(size[i])
        while p < end:
            c = text[p]
            out.append(c)
            p += _MOVE_ROWS[j & period][c]
            j += 1
        steps[i] = j
        lo, hi = np.searchsorted(_PLACES, [at, j])
        if hi > seen.shape[1]:
            seen = np.concatenate([seen, np.full((n, hi), END, np.uint8)], axis=1)
        seen[i, lo:hi] = np.frombuffer(out, np.uint8)[_PLACES[lo:hi] - at]
    return steps, seen


def fingerprints(texts: list[str]) -> np.ndarray:
    """Packed fingerprints, ``BITS / 8`` bytes each."""
    steps, seen = embed([classes(t) for t in texts])
    bits = np.zeros((len(texts), BITS), np.uint8)
    some = np.flatnonzero(steps)
    for k in range(BITS):
        place = _RECORDS[k][np.searchsorted(_RECORDS[k], steps[some], side="right") - 1] - 1
        bits[some, k] = _SIGN[k][seen[some, np.searchsorted(_PLACES, place)]]
    return np.packbits(bits, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal sampled characters: equal bits, corrected for chance ones."""
    same = BITS - np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return np.maximum(0.0, 2.0 * same / BITS - 1.0)


def packed(values: pa.Array) -> pa.Array:
    """Strings as their length in bytes and Zstandard's bytes; null stays null."""
    codec = pa.Codec("zstd", compression_level=LEVEL)
    return pa.array([None if x is None else len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) for x in values.cast(pa.binary()).to_pylist()], pa.binary())


def unpacked(values: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd")
    return pa.array([None if x is None else codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True) for x in values.to_pylist()], pa.binary()).cast(pa.string())


def with_next(df: DataFrame, key: str, text: str) -> DataFrame:
    """``piece, ahead, key, text``, to be read in this order within partitions.

    Rows lie in pieces of consecutive keys, and each piece ends with a copy of
    the row that begins the next one (the last with the first row of all),
    marked ``ahead``.  The only shuffle moves each text once, packed.
    """
    spark = df.sparkSession
    count, nulls = df.agg(F.count(F.lit(1)), F.count_if(F.col(key).isNull())).first()
    n = pieces(count, PIECE_ROWS, least=16 * shuffle_partitions(spark))
    keys = df.agg(F.percentile_approx(key, [i / n for i in range(n)], 20 * n), F.min(key), F.max(key)).first()
    bounds = np.array(sorted({keys[1], *(keys[0] or [])} - {None}) or [0], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                null = pa.compute.is_null(part.column(0)).to_numpy(zero_copy_only=False)
                k = pa.compute.fill_null(part.column(0), int(bounds[0])).to_numpy(zero_copy_only=False)
                own = np.maximum(np.searchsorted(bounds, k, side="right") - 1, 0)
                own[null] = 0
                opens = np.flatnonzero(~null & (bounds[own] == k) & (own > 0))
                first = np.flatnonzero(null if nulls else k == bounds[0])
                at = np.concatenate([np.arange(len(own)), opens, first])
                piece = np.concatenate([own, own[opens] - 1, np.full(len(first), len(bounds) - 1)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(piece, pa.int32()), pa.array(np.arange(len(at)) >= len(own)),
                    part.column(0).take(pa.array(at)), packed(part.column(1)).take(pa.array(at)),
                ], ["piece", "ahead", "key", "text"])

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                yield part.set_column(3, "text", unpacked(part.column(3)))

    docs = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    dealt = docs.mapInArrow(deal, "piece int, ahead boolean, key long, text binary").repartition("piece")
    # rows of one key are ordered by their texts, so these are unpacked before
    return dealt.mapInArrow(open_, "piece int, ahead boolean, key long, text string").sortWithinPartitions("piece", "ahead", "key", "text")


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Columns that are hexadecimal only in results: half the bytes until then.
HEXED = ("edited_sha256", "fingerprint", "edited_fingerprint")


def hexed(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lower(F.hex(c)) for c in HEXED if c in df.columns})


def edit_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` (a whole number) and :data:`RESULT` for every row.

    The edited text has its last ``n_chars // 2`` code points replaced by the
    first as many, or all, of the next row's text by ascending key, null first,
    then text; after the last row comes the first.  Null texts are empty; empty
    texts have the fingerprint of no bits set.  Repeated rows follow each other.
    Other columns play no part; an empty table gives an empty result.
    """
    return hexed(_digests(df, key, text))


def linked_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.9) -> DataFrame:
    """:func:`edit_fingerprints` with ``component_id, links`` of :func:`edit_groups`."""
    # read several times to link them, so written once
    return hexed(linked_prints(cut(_digests(df, key, text)), key, least))


def _digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """:func:`edit_fingerprints` with binary columns for :data:`HEXED`."""
    schema = f"`{key}` long, " + ", ".join(f"{c} {'binary' if c in HEXED else kind}" for c, kind in (x.split() for x in RESULT.split(", ")))
    if not df.limit(1).count():
        return df.sparkSession.createDataFrame([], schema)

    def digest(rows: list[tuple], following: list[str]) -> pa.RecordBatch:
        own = [r[2] for r in rows]
        n = [len(t) for t in own]
        edited = [t[: k - k // 2] + f[: k // 2] for t, k, f in zip(own, n, following, strict=True)]
        prints = fingerprints([*own, *edited, following[-1]])
        a, b = prints[: len(own)], prints[len(own) : -1]
        after = np.concatenate([a[1:], prints[-1:]])
        jump = [i for i in range(len(own) - 1) if following[i] is not own[i + 1]]
        if jump:
            after[jump] = fingerprints([following[i] for i in jump])
        return pa.RecordBatch.from_arrays([
            pa.array([r[1] for r in rows], pa.int64()), pa.array(n, pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in edited], pa.binary()),
            pa.array([x.tobytes() for x in a], pa.binary()), pa.array([x.tobytes() for x in b], pa.binary()),
            pa.array(likeness(a, b)), pa.array(likeness(a, after)),
        ], [key, *(x.split()[0] for x in RESULT.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the last row, whose next one is not known yet
        done = None  # the piece whose row ahead has been used
        for batch in batches:
            for part in slices(batch, "text", 3_000_000):
                rows, following = [], []
                for piece, ahead, k, t in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                    t = t or ""
                    if waiting is not None and piece == waiting[0]:
                        rows.append(waiting)
                        following.append(t)
                        waiting = None
                    if ahead:
                        done = piece
                    elif piece != done:
                        waiting = (piece, k, t)
                if rows:
                    yield digest(rows, following)
        if waiting is not None:
            raise RuntimeError("a piece without the row after it")

    return with_next(df, key, text).mapInArrow(run, schema)


def bit_bands(prints: np.ndarray, bands: int = 24, width: int = 24, seed: int = 9) -> np.ndarray:
    """Band keys of packed fingerprints: each band samples ``width`` bits, which the
    key holds beside the band's number."""
    rng = np.random.default_rng(seed)
    bits = np.unpackbits(prints, axis=1)
    place = 1 << np.arange(width, dtype=np.int64)
    return np.stack([(b << width) + bits[:, rng.choice(BITS, width, replace=False)] @ place for b in range(bands)], axis=1)


def _bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BITS // 8)


def print_keys(df: DataFrame) -> DataFrame:
    """``node, bucket`` for every band of ``df(node, fingerprint)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = bit_bands(_bits(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1])), pa.array(keys.ravel())], ["node", "bucket"])

    return df.select("node", "fingerprint").mapInArrow(run, "node long, bucket long")


def print_words(df: DataFrame) -> DataFrame:
    """``node, sig`` of ``df(node, fingerprint)``: its bits as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _bits(batch.column(1)).view(np.int64)
            at = pa.array(np.arange(len(sig) + 1) * sig.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(sig.ravel()))], ["node", "sig"])

    return df.select("node", "fingerprint").mapInArrow(run, "node long, sig array<long>")


def near_prints(a: F.Column, b: F.Column) -> F.Column:
    """:func:`likeness` of two hexadecimal fingerprints."""
    step = 15
    total = F.lit(0)
    for i in range(0, BITS // 4, step):
        x, y = (F.conv(F.substring(f, i + 1, step), 16, 10).cast("long") for f in (a, b))
        total = total + F.bit_count(x.bitwiseXOR(y))
    return F.greatest(F.lit(0.0), 2.0 * (BITS - total) / BITS - 1.0)


def _same_bits(sig: np.ndarray, i: int) -> np.ndarray:
    """Equal bits of row ``i`` with each row after it."""
    return BITS - np.bitwise_count(sig[i + 1 :] ^ sig[i]).sum(axis=1, dtype=np.int64)


def edit_groups(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.9) -> DataFrame:
    """``key, fingerprint, component_id, links``: texts whose whole fingerprints are
    at least ``least`` alike, in components named by their least key.

    Bands of sampled bits give buckets; in a bucket each fingerprint is compared
    with one hub, and where several components remain, all of them across
    components in blocks of bounded size, so no group is emitted pair by pair.
    ``links`` counts the links by which the component was found.  Null and empty
    texts have one fingerprint and are linked with nothing; repeated rows share
    theirs; an empty table gives an empty result.
    """
    kind = df.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        prints = fingerprints(texts)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([x.tobytes() for x in prints], pa.binary())], [key, "n_chars", "fingerprint"])

    rows = cut(map_batches(df.select(F.col(key), F.col(text).alias("_text")), "_text", work, f"`{key}` {kind}, n_chars long, fingerprint binary"))
    return hexed(linked_prints(rows, key, least)).select(key, "fingerprint", "component_id", "links")


def linked_prints(rows: DataFrame, key: str = "doc_id", least: float = 0.9) -> DataFrame:
    """``rows`` with ``component_id, links`` as :func:`edit_groups` finds them.

    ``rows`` holds ``key, n_chars, fingerprint`` (binary) and is read several times.
    Only what shares a bucket, and rows that share a node, move with more than a key.
    """
    need = int(np.ceil((least + 1.0) / 2.0 * BITS))
    name = F.xxhash64(F.lower(F.hex("fingerprint")))
    rows = rows.withColumn("node", F.when(F.col("n_chars") > 0, name))
    same = rows.where("node is not null").groupBy("fingerprint").agg(F.min(key).alias("least_key"), F.count("*").alias("copies"))
    nodes = cut(same.select(name.alias("node"), "fingerprint", "least_key", "copies"))
    # a row is two longs, so even one task can sort a hot bucket; there are too many buckets to shuffle them twice
    bucket = Window.partitionBy("bucket")
    each = print_keys(nodes).withColumns({"members": F.count("*").over(bucket), "hub": F.min("node").over(bucket)})
    members = cut(each.where("members > 1"))
    signed = cut(print_words(among(nodes.select("node", "fingerprint"), members, "node")))
    a, b = (signed.select(F.col("node").alias(x), F.col("sig").alias(f"s{x}")) for x in "ab")
    stars = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = cut(stars.join(a, "a").join(b, "b").where(bit_likeness(F.col("sa"), F.col("sb"), BITS // 64) >= need).select("a", "b"))
    groups = components(links)
    known = cut(members.where("members > 2").select("bucket", "node").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")))

    def across(table: pa.Table) -> list[tuple[int, int]]:
        node, side, label = (table[c].to_numpy() for c in ("node", "side", "component"))
        sig = table["sig"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)
        return [(node[i], node[j]) for i, j in _pairs_across(np.ones(len(node)), side, sig, label.copy(), need, 0, matching=_same_bits)]

    sent = in_blocks(known, open_buckets(known), BLOCK).join(signed, "node")
    more = cut(sent.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node").mapInArrow(_blocks(across), "a long, b long").distinct())
    if more.limit(1).count():
        links = links.union(more).distinct()
        groups = components(links)
    of = nodes.select("node", "least_key", "copies").join(groups, "node", "left").where("copies > 1 or component is not null").withColumn("component", F.coalesce("component", "node"))
    counted = links.join(of.select(F.col("node").alias("a"), "component"), "a").groupBy("component").agg(F.count("*").alias("links"))
    first = of.groupBy("component").agg(F.min("least_key").alias("component_id")).join(counted, "component", "left")
    final = cut(of.join(first, "component").select("node", "component_id", F.coalesce("links", F.lit(0)).alias("links")))
    some, alone = split_among(rows, final, "node")
    out = some.join(final, "node", "left").unionByName(alone.withColumns({"component_id": F.col(key), "links": F.lit(0)}))
    return out.withColumn("component_id", F.coalesce("component_id", F.col(key))).withColumn("links", F.coalesce("links", F.lit(0)).cast("long")).drop("node")
