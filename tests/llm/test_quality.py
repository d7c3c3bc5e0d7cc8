import re
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.llm.quality import GRAM_LIMITS, LINE_LIMIT, measure, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def spans_again(words, n):
    seen = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    inside = set()
    for i in range(len(words) - n + 1):
        if seen[tuple(words[i : i + n])] > 1:
            inside |= set(range(i, i + n))
    return inside


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    chars = sum(map(len, words))
    lines, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in lines:
                dup += 1
                dup_chars += sum(map(len, WORD.findall(line)))
            lines.add(line)
    repeat = len(spans_again(words, 3))
    shares = {n: sum(len(words[i]) for i in spans_again(words, n)) / max(chars, 1) for n in GRAM_LIMITS}
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    kept = not failed and dup_chars / max(chars, 1) <= LINE_LIMIT and all(shares[n] <= x for n, x in GRAM_LIMITS.items())
    return len(words), chars, sum(text.count(c) for c in "#*$%&|<>"), dup, repeat, failed, kept


def got(texts):
    out = measure(pa.array(texts, pa.string()))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return [tuple(out[k][i].item() for k in names) for i in range(len(texts))]


EDGE = ["", None, " ", "\n", "a", "é é é é\né é", "a b c a b c", "x\n\nx\nx\n", "a\n a\na ", "# * $", "w " * 60, "one two three four " * 30, " ".join(f"w{i}" for i in range(80)), ("line of words here\n") * 4 + " ".join(f"w{i}" for i in range(60))]


def test_edges_match_brute_force():
    assert got(EDGE) == [brute(x) for x in EDGE]
    assert got([]) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab é\n\t#", max_size=120)), max_size=8))
def test_random_texts_match_brute_force(texts):
    assert got(texts) == [brute(x) for x in texts]


def test_frame_keeps_rows_and_columns(spark):
    rows = [(i, x, "z") for i, x in enumerate(EDGE)] + [(0, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = quality_rules(df).collect()
    assert len(out) == len(rows) and {r.doc_id: (r.n_words, r.kept) for r in out} == {i: (brute(x)[0], brute(x)[-1]) for i, x, _ in rows}
    assert quality_rules(df.limit(0)).count() == 0
