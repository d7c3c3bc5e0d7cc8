"""Encoding and decoding by byte-pair merges, with a segment tree over adjacent pairs.

A pre-token starts as its bytes.  The leaves of a segment tree hold the ranks
of all adjacent pairs and their places, inner nodes the least of their
children, so the root is the leftmost pair of lowest rank.  Merging it changes
three leaves, each in logarithmic time; the work ends when the root holds no
pair.  A pre-token of ``n`` bytes takes ``O(n log n)`` steps, however long it
is.

White space never lies inside a pre-token, so texts are cut at white space and
each distinct chunk is merged once per worker.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_buffer, unused
from .tokens import _BYTE_LEVEL, per_worker

#: Chunks, and pre-tokens, remembered per Python worker before it starts anew, and the longest of them.
MOST_CHUNKS, LONGEST_CHUNK = 450_000, 200
BYTE_CHARACTERS = str.maketrans({chr(b): c for b, c in _BYTE_LEVEL.items()})
#: No pair: above every rank and place.
NO_PAIR = 1 << 62
#: Symbols of the longest pre-tokens that are merged many at a time, and places of a forest.
WIDEST, FOREST = 64, 1 << 19
#: White space on which Python and the tokenizers may differ; such texts are not cut.
ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏ -  ⁠　﻿]")
#: Chunks that are one pre-token whatever the library's Unicode tables say: Latin letters with simple lower case.
LATIN_WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]+")
#: Fixed value: the pre-splitting pattern of the vocabulary file, for lower-case ASCII.
ASCII_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\\sa-z0-9]+")


class PairTree:
    """Least of ``rank, place`` over the adjacent pairs of a sequence, with point updates."""

    def __init__(self, keys: Sequence[int]):
        self.size = 1 << max(len(keys) - 1, 0).bit_length()
        self.nodes = [NO_PAIR] * self.size + list(keys) + [NO_PAIR] * (self.size - len(keys))
        for at in range(self.size - 1, 0, -1):
            self.nodes[at] = min(self.nodes[2 * at], self.nodes[2 * at + 1])

    def least(self) -> int:
        return self.nodes[1]

    def put(self, place: int, key: int) -> None:
        """Change one leaf and its ancestors, up to the first that stays as it is."""
        nodes, at = self.nodes, self.size + place
        nodes[at] = key
        while at > 1:
            at >>= 1
            low = min(nodes[2 * at], nodes[2 * at + 1])
            if nodes[at] == low:
                return
            nodes[at] = low


def merge_pairs(ids: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """``ids`` after all merges of ``pairs`` (rank and new id of each), lowest rank first, leftmost among equals."""
    n = len(ids)
    if n < 2:
        return ids
    ids, bits = list(ids), n.bit_length()

    def key(i: int, j: int) -> int:
        found = pairs.get((ids[i], ids[j]))
        return NO_PAIR if found is None else found[0] << bits | i

    tree = PairTree([key(i, i + 1) for i in range(n - 1)])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (least := tree.least()) != NO_PAIR:
        i = least & ((1 << bits) - 1)
        j = after[i]
        ids[i], ids[j] = pairs[ids[i], ids[j]][1], -1
        after[i] = k = after[j]
        if j < n - 1:
            tree.put(j, NO_PAIR)
        if k < n:
            before[k] = i
        tree.put(i, key(i, k) if k < n else NO_PAIR)
        if before[i] >= 0:
            tree.put(before[i], key(before[i], i))
    return [x for x in ids if x >= 0]


class PairTable:
    """Ranks and results of pairs, looked up for many at once."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], size: int):
        keys = np.array([a * size + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.size, self.keys = size, keys[order]
        self.rank, self.result = (np.array([v[c] for v in pairs.values()], np.int64)[order] for c in (0, 1))

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the table, and which of these are the pairs asked for; negative ids have none."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, (self.keys[at] == key) & (a >= 0) & (b >= 0)


def merge_forest(ids: np.ndarray, table: PairTable) -> np.ndarray:
    """All rows of ``ids`` merged at once, each by its own segment tree; ids of -1 are free places.

    A row holds its ids from the left; its width is a power of two.  Each round
    merges the pair at the root of every tree that has one.
    """
    n, width = ids.shape
    bits, ids = width.bit_length() - 1, ids.copy()
    nothing = np.int64(NO_PAIR)

    def keys(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        at, hit = table.find(ids[rows, i], np.where(j < width, ids[rows, np.minimum(j, width - 1)], -1))
        return np.where(hit, table.rank[at] << bits | i, nothing)

    nodes = np.full((n, 2 * width), nothing)
    for i in range(width - 1):
        nodes[:, width + i] = keys(np.arange(n), np.full(n, i), np.full(n, i + 1))
    for at in range(width - 1, 0, -1):
        nodes[:, at] = np.minimum(nodes[:, 2 * at], nodes[:, 2 * at + 1])
    after, before = np.tile(np.arange(1, width + 1), (n, 1)), np.tile(np.arange(-1, width - 1), (n, 1))

    def put(rows: np.ndarray, place: np.ndarray, key: np.ndarray) -> None:
        at = width + place
        nodes[rows, at] = key
        for _ in range(bits):
            at = at >> 1
            nodes[rows, at] = np.minimum(nodes[rows, 2 * at], nodes[rows, 2 * at + 1])

    rows = np.flatnonzero(nodes[:, 1] < nothing)
    while len(rows):
        i = nodes[rows, 1] & (width - 1)
        j = after[rows, i]
        at, _ = table.find(ids[rows, i], ids[rows, j])
        ids[rows, i], ids[rows, j] = table.result[at], -1
        k = after[rows, i] = after[rows, j]
        inner = k < width
        before[rows[inner], k[inner]] = i[inner]
        put(rows, j, np.full(len(rows), nothing))
        put(rows, i, keys(rows, i, k))
        h = before[rows, i]
        some = h >= 0
        put(rows[some], h[some], keys(rows[some], h[some], i[some]))
        rows = rows[nodes[rows, 1] < nothing]
    return ids


class Codec:
    """A vocabulary file with word ends: normalising and pre-splitting by the library, merging by segment trees."""

    def __init__(self, path: str):
        library = tokenizers.Tokenizer.from_file(path)
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as lines:
            model = json.load(lines)["model"]
        self.end, self.vocab = model["end_of_word_suffix"] or "", model["vocab"]
        self.pairs = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        self.special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        self.names = {i: s for s, i in (self.vocab | self.special).items()}
        self.table = PairTable(self.pairs, max(self.names) + 1)
        # ids of single characters by code point, inside a pre-token and at its end
        self.inner, self.final = np.full(1024, -1, np.int64), np.full(1024, -1, np.int64)
        for text, i in self.vocab.items():
            for ids, char in ((self.inner, text), (self.final, text.removesuffix(self.end) if self.end and text.endswith(self.end) else "")):
                if len(char) == 1 and ord(char) < 1024:
                    ids[ord(char)] = i
        if not self.end:
            self.final = self.inner
        # the short cuts of ``pieces`` hold for this file only
        self.plain = os.path.basename(path) == "word_bpe_49k.json"
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        self.chunks: dict[str, tuple[bytes, str]] = {}
        self.known: dict[str, tuple[bytes, str]] = {}

    def pieces(self, chunk: str) -> list[str]:
        """Pre-tokens of a text without special strings, in the characters of the vocabulary."""
        if self.plain:
            if chunk.isascii() and chunk.isprintable() and " " not in chunk:
                return ASCII_PIECES.findall(chunk.lower())
            if LATIN_WORD.fullmatch(chunk):
                return [chunk.lower().encode().decode("latin-1").translate(BYTE_CHARACTERS)]
        return [p for p, _ in self.split(self.normalise(chunk))]

    def decode(self, ids: Sequence[int]) -> str:
        """The vocabulary strings of ``ids`` with a space between them; ids that name none are left out."""
        return " ".join([self.names[i] for i in ids if i in self.names])

    def merge(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each pre-token; long ones one by one, the others in forests of trees of equal width."""
        out: list[list[int]] = [[] for _ in pieces]
        lengths = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(lengths)
        codes = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32).astype(np.int64)
        symbols = self.inner[codes]
        symbols[ends - 1] = self.final[codes[ends - 1]]
        for i in np.flatnonzero(lengths > WIDEST).tolist():
            out[i] = merge_pairs(symbols[ends[i] - lengths[i] : ends[i]].tolist(), self.pairs)
        width = 2
        while width <= WIDEST:
            of = np.flatnonzero((lengths <= width) & (lengths > (width // 2 if width > 2 else 0)))
            for at in range(0, len(of), FOREST // width):
                some = of[at : at + FOREST // width]
                inside = np.arange(width) < lengths[some][:, None]
                ids = np.full((len(some), width), -1, np.int64)
                ids[inside] = symbols[np.repeat(ends[some] - np.cumsum(lengths[some]), lengths[some]) + np.arange(lengths[some].sum())]
                ids = merge_forest(ids, self.table)
                flat, stops = ids[ids >= 0].tolist(), np.cumsum((ids >= 0).sum(1)).tolist()
                for i, a, b in zip(some.tolist(), [0, *stops[:-1]], stops, strict=True):
                    out[i] = flat[a:b]
            width *= 2
        return out

    def add(self, chunks: set[str]) -> dict[str, tuple[bytes, str]]:
        """Ids (as 32-bit bytes) and decoded text of each chunk; pre-tokens that were met before are not merged again."""
        pieces = {c: self.pieces(c) for c in chunks}
        distinct = {p for ps in pieces.values() for p in ps}
        if len(self.known) + len(distinct) > MOST_CHUNKS:
            self.known.clear()
        known, fresh = self.known, list(distinct.difference(self.known))
        if fresh:
            names = self.names
            long = {}
            for piece, ids in zip(fresh, self.merge(fresh), strict=True):
                (known if len(piece) <= LONGEST_CHUNK else long)[piece] = array("i", ids).tobytes(), " ".join([names[i] for i in ids])
            if long:
                known = known | long
        out = {}
        for chunk, ps in pieces.items():
            if len(ps) == 1:
                out[chunk] = known[ps[0]]
            else:
                got = [known[p] for p in ps]
                out[chunk] = b"".join([g[0] for g in got]), " ".join([g[1] for g in got])
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Ids as 32-bit bytes, and the decoded text, of each text."""
        cut, new = [], set()
        for text in texts:
            parts: list[str] = []
            for i, piece in enumerate(self.marks.split(text or "") if self.marks else [text or ""]):
                parts += [piece] if i % 2 or ODD_SPACE.search(piece) else piece.split()
            cut.append(parts)
            new.update(parts)
        if len(self.chunks) + len(new) > MOST_CHUNKS:
            self.chunks.clear()
        new.difference_update(self.chunks)
        fresh = self.add({c for c in new if c not in self.special})
        fresh |= {s: (array("i", [i]).tobytes(), s) for s, i in self.special.items()}
        self.chunks |= {c: v for c, v in fresh.items() if len(c) <= LONGEST_CHUNK}
        long = {c: v for c, v in fresh.items() if len(c) > LONGEST_CHUNK}
        out = []
        for parts in cut:
            got = [long.get(c) or self.chunks[c] for c in parts] if long else list(map(self.chunks.__getitem__, parts))
            out.append((b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[0]])))
        return out


def bpe_round_trip(df: DataFrame, text: str = "text", keep: list[str] | None = None, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """``keep`` columns (all but ``text`` by default) with ``ids array<int>``, the
    tokens of the whole text, and ``decoded string``, the text that they give back.

    ``vocabulary`` names a file of the public tokenizers, which each worker
    opens from its own installation.  Special strings inside a text are their
    own ids.  Null and empty texts have no ids and an empty decoded text;
    repeated rows are encoded one by one; an empty table gives an empty
    result; a ``keep`` column named like a result is an error.
    """
    names = {"ids", "decoded"}
    keep = [c for c in df.columns if c != text and c.lower() not in names] if keep is None else keep
    if clash := names & {c.lower() for c in keep}:
        raise ValueError(f"columns clash with results: {sorted(clash)}")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "ids array<int>, decoded string"])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = per_worker(Codec, public_tokenizers.path(vocabulary))
        done = codec.encode(batch.column(batch.num_columns - 1).to_pylist())
        ends = np.zeros(len(done) + 1, np.int64)
        np.cumsum([len(d[0]) // 4 for d in done], out=ends[1:])
        ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join([d[0] for d in done]), np.int32)))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keep))), ids, pa.array([d[1] for d in done], pa.string())], [*keep, "ids", "decoded"])

    name = unused(keep, "_text")
    return map_batches(df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias(name)), name, work, schema, 1_000_000)


def bpe_decode(df: DataFrame, ids: str = "ids", keep: list[str] | None = None, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """``keep`` columns (all but ``ids`` by default) with ``decoded``, the text of ``ids``; null and empty lists give an empty text."""
    keep = [c for c in df.columns if c not in (ids, "decoded")] if keep is None else keep
    if "decoded" in {c.lower() for c in keep}:
        raise ValueError("a column clashes with the result: decoded")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches):
        for batch in batches:
            codec = per_worker(Codec, public_tokenizers.path(vocabulary))
            out = [codec.decode(x or []) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keep))), pa.array(out, pa.string())], [*keep, "decoded"])

    rows = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{ids}`").alias(unused(keep, "_ids")))
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "decoded string"]))


def bpe_digests(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with ``n_tokens`` and the digests of ``ids`` and ``decoded``; ids are joined in decimal, a space between them."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return df.select(*keep, F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
