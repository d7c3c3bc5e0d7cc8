"""Token counts and ids by the public tokenizers, with the whole-token shortcut.

A text is cut at white space into chunks; a tokenizer that pre-splits at white
space gives each chunk the same tokens wherever it lies, so each distinct chunk
is tokenised once per worker and all others are looked up by hash in numpy.

For counts the shortcut is proved offline: every string of the vocabulary is
run through the library once, and those that come out as one token are kept in
a set; a pre-token in that set counts 1 without any merging, and only the rest
go through the library's merges.  Texts with special strings or with unusual
white space go to the library whole, which is what defines the result.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import map_batches, text_buffer, unused

#: Distinct chunks remembered per Python worker before it starts anew.
MOST_REMEMBERED = 400_000
#: White space other than space, tab, line feed and carriage return, as UTF-8.
ODD_SPACE = re.compile(rb"[\x0b\x0c\x1c-\x1f]|\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2(?:\x80[\x80-\x8f\xa8\xa9\xaa-\xaf]|\x81[\x9f\xa0])|\xe3\x80\x80|\xef\xbb\xbf")

_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = {b: chr(b) for b in _BYTES} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_BYTES))}


def whole_texts(data: np.ndarray, offsets: np.ndarray, marks: list[bytes]) -> np.ndarray:
    """Numbers of the texts that must go to the library whole."""
    raw = data.tobytes()
    hits = [m.start() for m in ODD_SPACE.finditer(raw)]
    for mark in marks:
        at = raw.find(mark)
        while at >= 0:
            hits.append(at)
            at = raw.find(mark, at + 1)
    return np.unique(np.searchsorted(offsets, np.array(hits, np.int64), side="right") - 1) if hits else np.zeros(0, np.int64)


class WholeTokens:
    """Counts of a tokenizer whose pre-tokens never cross white space and end in ``</w>``."""

    def __init__(self, path: str):
        self.library = tokenizers.Tokenizer.from_file(path)
        self.model = self.library.model
        self.normalise = self.library.normalizer.normalize_str
        # Fixed value: the pre-splitting pattern of the vocabulary file.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.specials = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[int, int] = {}
        self.whole = self.prove()

    def prove(self) -> frozenset[str]:
        """Pre-tokens that the library turns into one token, by trying each vocabulary string."""
        back = {c: b for b, c in _BYTE_LEVEL.items()}
        found = []
        for token in self.library.get_vocab(with_added_tokens=False):
            if token.endswith("</w>") and all(c in back for c in token[:-4]):
                if len(self.model.tokenize(token[:-4])) == 1:
                    try:
                        found.append(bytes(back[c] for c in token[:-4]).decode())
                    except UnicodeDecodeError:
                        continue
        return frozenset(found)

    def pre_token(self, piece: str) -> int:
        return 1 if piece in self.whole else len(self.model.tokenize("".join(map(_BYTE_LEVEL.__getitem__, piece.encode()))))

    def chunk(self, chunk: str) -> int:
        chunk = chunk.lower() if chunk.isascii() else self.normalise(chunk)
        return 1 if chunk in self.whole and self.split(chunk) == [chunk] else sum(map(self.pre_token, self.split(chunk)))

    def counts(self, texts: pa.Array) -> np.ndarray:
        data, offsets = text_buffer(texts)
        starts, ends, bounds = K.words(data, offsets)
        hashes = K.span_hashes(data, starts, ends)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > max(MOST_REMEMBERED, len(distinct)):
            self.known.clear()
        known, raw = self.known, data.tobytes()
        value = np.zeros(len(distinct), np.int64)
        for i, h in enumerate(distinct.tolist()):
            n = known.get(h)
            if n is None:
                n = known[h] = self.chunk(raw[starts[first[i]] : ends[first[i]]].decode())
            value[i] = n
        out = K.segment_sums(value[inverse], bounds)
        for i in whole_texts(data, offsets, self.specials).tolist():
            out[i] = len(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids)
        return out


_WORKER: dict[tuple, object] = {}


def per_worker(kind: type, *args):
    """One instance per Python worker."""
    if (kind, *args) not in _WORKER:
        _WORKER[kind, *args] = kind(*args)
    return _WORKER[kind, *args]


def token_counts(df: DataFrame, text: str = "text", keep: list[str] | None = None, vocabulary: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """``keep`` columns (all but ``text`` by default) with ``n_bytes, n_tokens, over_limit``.

    ``vocabulary`` names a file of the public tokenizers, which each worker
    opens from its own installation.  Null and empty texts have 0 bytes and 0
    tokens; repeated rows are counted one by one; an empty table gives an
    empty result.
    """
    names = {"n_bytes", "n_tokens", "over_limit"}
    keep = [c for c in df.columns if c != text and c not in names] if keep is None else keep
    if clash := names & set(keep):
        raise ValueError(f"columns clash with results: {sorted(clash)}")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_bytes long, n_tokens long, over_limit boolean"])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = per_worker(WholeTokens, public_tokenizers.path(vocabulary))
        texts = batch.column(batch.num_columns - 1)
        n = counter.counts(texts)
        size = np.diff(text_buffer(texts)[1])
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keep))), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], [*keep, "n_bytes", "n_tokens", "over_limit"])

    name = unused(keep, "_text")
    return map_batches(df.select(*(F.col(f"`{c}`") for c in keep), F.col(text).alias(name)), name, work, schema)


class ByteIds:
    """Ids of the byte-level vocabulary, as the library gives them without special tokens.

    The same vocabulary as ranks gives the same ids several times faster where
    a text holds no special string and no unusual white space; other texts go
    to the library itself.
    """

    def __init__(self, vocabulary: str, ranks: str):
        self.library = tokenizers.Tokenizer.from_file(public_tokenizers.path(vocabulary))
        with open(public_tokenizers.path(ranks), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.odd = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff]")

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.odd.search(text) is None and not any(s in text for s in self.specials):
            return self.encode(text)
        return self.library.encode(text, add_special_tokens=False).ids
