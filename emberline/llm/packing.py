"""Packing documents into windows by non-negative least squares.

Each document's ids are cut into whole windows, each a sequence of its own, and
a tail.  Tails go to shards of bounded size by a hash of their row.  Within a
shard the tails' length classes form a histogram; all shallow combinations of
classes that fill the window are enumerated, repeat counts that reproduce the
histogram are solved by non-negative least squares and rounded down, and what
the combinations leave is packed greedily: it first closes the small gaps that
the classes' rounding leaves and then fills windows one after the other, cut
where they end.  A shard's last window is cut at powers of two, which need no
padding.  Shards depend on nothing outside them, so any number run at once.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, pieces
from .tokens import ByteIds, per_worker

#: Rows in a shard, about; a shard's tails are held in memory at once.
SHARD_ROWS = 4096
#: Length classes in a window.
CLASSES = 64
#: Tails in a combination at most.
DEPTH = 3


@cache
def combinations(classes: int = CLASSES, depth: int = DEPTH) -> np.ndarray:
    """All multisets of up to ``depth`` classes that add up to the window: one
    column each, with the times that each class (row, from 1) occurs."""
    found: list[list[int]] = []

    def extend(chosen: list[int], rest: int) -> None:
        if rest == 0:
            found.append(chosen)
        elif len(chosen) < depth:
            for c in range(chosen[-1] if chosen else 1, rest + 1):
                extend([*chosen, c], rest - c)

    extend([], classes)
    out = np.zeros((classes, len(found)))
    for j, chosen in enumerate(found):
        np.add.at(out[:, j], np.array(chosen) - 1, 1)
    return out


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """``x >= 0`` with least ``|a x - b|``, by active sets."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(3 * a.shape[0]):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= tolerance * max(1.0, float(b.max(initial=0))):
            break
        free[j] = True
        while True:
            z = np.zeros_like(x)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (z <= 1e-12)
            if not low.any():
                x = z
                break
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = np.maximum(x + min(1.0, step) * (z - x), 0)
            gone = free & (x <= 1e-12)
            if not gone.any():
                gone = low
            free &= ~gone
            x[~free] = 0
            if not free.any():
                break
        if not free.any():
            break
    return x


def plan(lengths: np.ndarray, window: int = 1024) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces ``(tail, start, length)`` that hold every tail once.

    ``lengths`` are below ``window``; empty tails have no piece.
    """
    unit = window // CLASSES
    kind = -(-lengths // unit)
    waiting: list[list[int]] = [np.flatnonzero(kind == c).tolist()[::-1] for c in range(CLASSES + 1)]
    patterns = combinations()
    times = np.floor(nnls(patterns, np.array([len(w) for w in waiting[1:]], float)) + 1e-6).astype(int)
    sequences: list[list[tuple[int, int, int]]] = []
    for j in np.argsort(-times, kind="stable"):
        need = patterns[:, j].astype(int)
        some = np.flatnonzero(need)
        for _ in range(min(int(times[j]), *(len(waiting[c + 1]) // need[c] for c in some))):
            sequences.append([(t := waiting[c + 1].pop(), 0, int(lengths[t])) for c in some for _ in range(need[c])])
    rest = sorted((t for w in waiting[1:] for t in w), key=lambda t: (-lengths[t], t))
    # the rest is one stream of pieces, cut wherever a window is full
    stream, at = iter(rest), 0
    current = next(stream, None)

    def take(room: int) -> list[tuple[int, int, int]]:
        nonlocal current, at
        out = []
        while room and current is not None:
            n = min(room, int(lengths[current]) - at)
            out.append((current, at, n))
            room, at = room - n, at + n
            if at == lengths[current]:
                current, at = next(stream, None), 0
        return out

    for s in sequences:
        s += take(window - sum(n for *_, n in s))
    while current is not None:
        s = take(window)
        if (total := sum(n for *_, n in s)) == window:
            sequences.append(s)
            continue
        for size in (1 << k for k in reversed(range(total.bit_length())) if total >> k & 1):
            part, room = [], size
            while room:
                t, a, n = s.pop(0)
                m = min(n, room)
                part.append((t, a, m))
                room -= m
                if m < n:
                    s.insert(0, (t, a + m, n - m))
            sequences.append(part)
    return sequences


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_sequences(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 1024, end: int = 0, vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per piece: ``key`` and :data:`PIECES`.

    A document is its ids and then ``end``; a null or empty text is ``end``
    alone.  Repeated rows and ties are documents of their own.  An empty table
    gives an empty result.  Other columns play no part.
    """
    if window % CLASSES or window & (window - 1):
        raise ValueError("the window must be a power of two and hold the length classes")
    key_type = df.schema[key].dataType.simpleString()

    def tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids_of = per_worker(ByteIds, vocabulary, ranks)
        totals, crcs, tails = [], [], []
        for text in batch.column(1):
            ids = np.array([*ids_of(text.as_py()), end], np.uint16)
            whole = len(ids) // window * window
            totals.append(len(ids))
            crcs.append([_crc(ids[i : i + window]) for i in range(0, whole, window)])
            tails.append(ids[whole:].tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary())], ["key", "total", "crcs", "tail"])

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(table["row"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        total = table["total"].to_numpy()
        tails = [np.frombuffer(x, np.uint16) for x in table["tail"].to_pylist()]
        out: list[tuple[int, ...]] = []
        sequence = table["shard"][0].as_py() << 32
        for i, crcs in enumerate(table["crcs"].to_pylist()):
            for k, crc in enumerate(crcs):
                out.append((i, k * window, window, crc, sequence, 0))
                sequence += 1
        for s in plan(np.array([len(x) for x in tails], np.int64), window):
            offset = 0
            for i, a, n in s:
                whole = int(total[i]) // window * window
                out.append((i, whole + a, n, _crc(tails[i][a : a + n]), sequence, offset))
                offset += n
            sequence += 1
        row, start, length, crc, seq, offset = (np.array(c, np.int64) for c in zip(*out, strict=True))
        return pa.table({"key": table["key"].take(pa.array(row)), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": total[row], "sequence_id": seq, "offset": offset})

    spread = cut(map_batches(df.select(F.col(key).alias("key"), F.col(text).alias("_text")), "_text", tokens, f"key {key_type}, total long, crcs array<long>, tail binary"))
    shards = pieces(spread.count(), SHARD_ROWS, most=1 << 30)
    rows = spread.withColumn("row", F.monotonically_increasing_id()).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    return rows.groupBy("shard").applyInArrow(pack, f"key {key_type}, {PIECES}").withColumnRenamed("key", key)
