"""Quality rules by repetition coverage.

Rolling hashes of word n-grams of several lengths give the characters that lie
inside duplicated n-grams; line hashes give those inside duplicated lines.  A
text is kept when each share stays under its limit.  Everything is local to a
row, so there is no shuffle and no state beyond one bounded batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import map_batches, text_buffer, unused

#: Largest share of a text's word characters inside n-grams that occur again, by n.
GRAM_LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
#: Largest share of word characters in lines equal to an earlier line of the text.
LINE_LIMIT = 0.30
MIN_WORDS = 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, gram_shares array<double>, line_share double, base_failed boolean, kept boolean"


def _repeated(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which items have an equal item in the same text."""
    keys = K.mix(hashes + owner.astype(np.uint64) * K.BASE)
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def _later(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which items equal an earlier item of the same text."""
    keys = K.mix(hashes + owner.astype(np.uint64) * K.BASE)
    out = np.ones(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = False
    return out


def measure(texts: pa.Array, gram_limits: dict[int, float] = GRAM_LIMITS, line_limit: float = LINE_LIMIT, min_words: int = MIN_WORDS) -> dict[str, np.ndarray | list]:
    """The figures of :data:`RESULT` for each text (null: no words)."""
    data, offsets = text_buffer(texts)
    starts, ends, bounds = K.words(data, offsets)
    n_words = np.diff(bounds)
    total = len(starts)
    owner = K.owners(bounds, total)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(K.code_points(data), out=points[1:])
    chars = points[ends] - points[starts]
    word_chars = K.segment_sums(chars, bounds)
    hashes = K.span_hashes(data, starts, ends)

    candidates = np.arange(total)

    def dup(n: int) -> np.ndarray:
        # lengths ascend, and a longer n-gram recurs only where a shorter one does
        nonlocal candidates
        inside = K.gram_mask(bounds, total, n)
        at = candidates[candidates < len(inside)]
        at = at[inside[at]]
        candidates = at[_repeated(K.grams(hashes, n)[at], owner[at])] if len(at) else at
        return K.covered(candidates, n, total)

    n_repeat_words = K.segment_sums(dup(3), bounds)
    safe = np.maximum(word_chars, 1)
    shares = [K.segment_sums(np.where(dup(n), chars, 0), bounds) / safe for n in sorted(gram_limits)]

    # lines: cut at \n and at text ends
    is_break = data == 10
    begins = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(is_break) + 1]))
    begins = begins[begins < len(data)] if len(data) else np.zeros(0, np.int64)
    text_of = np.searchsorted(offsets, begins, side="right") - 1
    stops = np.minimum(np.append(begins[1:], len(data)), offsets[text_of + 1])
    stops = stops - ((stops > begins) & is_break[stops - 1]) if len(begins) else stops
    first = np.searchsorted(starts, begins)
    last = np.searchsorted(starts, stops)
    full = last > first
    begins, stops, text_of, first, last = (x[full] for x in (begins, stops, text_of, first, last))
    again = _later(K.span_hashes(data, begins, stops), text_of)
    n = len(offsets) - 1
    n_dup_lines = np.bincount(text_of[again], minlength=n) if n else np.zeros(0, np.int64)
    ends_at = np.zeros(total + 1, np.int64)
    np.cumsum(chars, out=ends_at[1:])
    line_chars = np.bincount(text_of[again], weights=(ends_at[last] - ends_at[first])[again], minlength=n) if n else np.zeros(0)
    line_share = line_chars / safe

    failed = (n_words < min_words) | (100 * n_repeat_words > 50 * n_words)
    good = ~failed & (line_share <= line_limit)
    for share, length in zip(shares, sorted(gram_limits), strict=True):
        good &= share <= gram_limits[length]
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": K.segment_sums(SYMBOLS[data], offsets),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat_words,
        "gram_shares": np.stack(shares, axis=1) if n else np.zeros((0, len(gram_limits))),
        "line_share": line_share,
        "base_failed": failed,
        "kept": good,
    }


def quality_rules(df: DataFrame, text: str = "text", keep: list[str] | None = None, **limits) -> DataFrame:
    """``keep`` columns (all but ``text`` by default) with the figures of :data:`RESULT`.

    Null and empty texts have no words and fail the base rules; repeated rows
    are judged one by one; an empty table gives an empty result.  Columns of
    the input named like a result column are left out unless listed in
    ``keep``, which is an error.
    """
    names = {x.split()[0] for x in RESULT.split(", ")}
    keep = [c for c in df.columns if c != text and c not in names] if keep is None else keep
    if clash := names & set(keep):
        raise ValueError(f"columns clash with results: {sorted(clash)}")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), RESULT])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = measure(batch.column(batch.num_columns - 1), **limits)
        shares = got["gram_shares"]
        got["gram_shares"] = pa.ListArray.from_arrays(np.arange(len(shares) + 1, dtype=np.int32) * shares.shape[1], shares.ravel())
        got = {k: v if isinstance(v, pa.Array) else pa.array(v, pa.bool_() if v.dtype == bool else pa.float64() if v.dtype == float else pa.int64()) for k, v in got.items()}
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keep))), *got.values()], [*keep, *got])

    name = unused(keep, "_text")
    return map_batches(df.select(*(F.col(f"`{c}`") for c in keep), F.col(text).alias(name)), name, work, schema)


def keep_good(df: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The rows whose text the rules keep, with all their columns.  Texts pass by
    in bounded pieces and nothing is shuffled or joined."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    at = df.columns.index(text)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(measure(batch.column(at), **limits)["kept"]))

    return map_batches(df, text, work, schema)
