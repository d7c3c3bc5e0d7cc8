import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.llm import substrings as S
from emberline.llm import common, suffixes, winnow


def brute(rows, length):
    seen = defaultdict(int)
    raws = [(k, (t or "").encode()) for k, t in rows]
    for _, raw in raws:
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] += 1
    out = []
    for k, raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        spans = int((np.diff(gone.astype(int)) == 1).sum() + gone[0])
        out.append((k, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_passages(rows, length):
    seen = defaultdict(set)
    own = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in rows]
    for d, (_, words) in enumerate(own):
        for i in range(len(words) - length + 1):
            seen[tuple(words[i : i + length])].add(d)
    out = []
    for k, words in own:
        held = np.zeros(len(words) + 1, bool)
        for i in range(len(words) - length + 1):
            if len(seen[tuple(words[i : i + length])]) > 1:
                held[i : i + length] = True
        out.append((k, int((np.diff(held.astype(int)) == 1).sum() + held[0]), int(held.sum())))
    return sorted(out, key=str)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=8), st.integers(1, 12))
def test_suffix_array_common_prefixes_and_search(segments, length):
    data = np.frombuffer(b"".join(segments), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in segments])])
    end = np.repeat(bounds[1:], np.diff(bounds))
    suffix = [bytes(data[i : end[i]]) for i in range(len(data))]
    order = suffixes.suffix_array(data, bounds)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: (suffix[i], i))
    shared = suffixes.common_prefixes(data, bounds, order, 1000)
    for a, b in zip(order, order[1:], strict=False):
        n = next((k for k, (x, y) in enumerate(zip(suffix[a], suffix[b], strict=False)) if x != y), min(len(suffix[a]), len(suffix[b])))
        assert shared[b] == n
    full = order[order + length <= end[order]]
    found = suffixes.search(data, full, data, full, length)
    for i, f in zip(full, found, strict=True):
        assert suffix[full[f]][:length] == suffix[i][:length] and (f == 0 or suffix[full[f - 1]][:length] != suffix[i][:length])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=5))
def test_equal_strings_choose_equal_anchors(texts):
    raws = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raws), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
    length, gram = 12, 5
    chosen, starts = {}, 0
    for t, low, high, anchor, _ in zip(*winnow.runs(data, offsets, length, gram), strict=True):
        for s in range(low, high + 1):
            assert s <= anchor <= s + length - gram
            assert chosen.setdefault(raws[t][s : s + length], anchor - s) == anchor - s
            starts += 1
    assert starts == sum(max(0, len(r) - length + 1) for r in raws)


def corpus():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(30) for _ in range(4)]
    docs = [None, "", "short", "x" * 500, "x" * 399, "ab " * 300, "ab " * 200 + "c"]
    for i in range(120):
        parts = [text(r.randint(1, 40)) for _ in range(3)]
        if i % 2:
            parts.insert(r.randint(0, 3), shared[i % 4])
        if i % 10 == 0:
            parts += [parts[0]] * 2
        docs.append(" ".join(parts))
    docs += [docs[10], docs[10], docs[11][:-1], docs[12][5:], "line of text\n" * 60 + docs[13]]
    return [(i, t) for i, t in enumerate(docs)] + [(9, docs[9])]


def got(df, **how):
    out = S.remove_repeats(df, **how).collect()
    rows = df.select("doc_id", "text").collect()
    words = how.get("words", S.PASSAGE)
    assert sorted(((r.doc_id, r.n_passages, r.n_passage_words) for r in out), key=str) == brute_passages([(r.doc_id, r.text) for r in rows], words)
    assert all(sum(x.high - x.low for x in r.passages) == r.n_passage_words and len(r.passages) == r.n_passages for r in out)
    assert all(sum(x.high - x.low for x in r.removed) == r.n_removed and len(r.removed) == r.n_spans for r in out)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=str)


def test_matches_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, n_bytes string").repartition(4)
    assert got(df, length=100, gram=32) == brute(rows, 100)
    # groups split into parts, merged by search; heavy keys joined by broadcast
    monkeypatch.setattr(S, "PART", 5)
    monkeypatch.setattr(common, "HEAVY", 3)
    assert got(df, length=100, gram=32, words=12, word_gram=4) == brute(rows, 100)
    assert got(df.limit(0)) == []


def test_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(df) == brute(rows, 400)


def test_passages_about_the_length(spark):
    """Passages of 399, 400 and 401 bytes in two documents each: the first stays."""
    r = random.Random(9)
    letters = lambda n, alphabet: "".join(r.choice(alphabet) for _ in range(n))
    rows, want = [], {}
    for k, n in enumerate((399, 400, 401)):
        passage = letters(n, "abcdefgh ")
        for j in range(2):
            # what surrounds the passage differs from its other place
            rows.append((2 * k + j, letters(300, "ABCD") + "xy"[j] + passage + "zw"[j] + letters(300, "EFGH")))
            want[2 * k + j] = n if n >= 400 else 0
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.n_removed for x in S.remove_repeats(df).collect()} == want
    assert got(df) == brute(rows, 400)


def test_a_core_with_more_segments_than_a_part(spark):
    """3,000 documents share 350 bytes; some of them share 400 and more."""
    r = random.Random(10)
    letters = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    common = letters(350)
    rows = [(i, letters(60) + common + letters(60)) for i in range(3000)]
    rows += [(3000 + i, letters(30) + rows[70 * i][1][20 + i : 440] + letters(20)) for i in range(40)]
    assert len(rows) > S.PART
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)) == brute(rows, 400)


def test_passages_spaced_otherwise(spark):
    """Fifty words count however they are spaced, forty-nine do not, copies count whole."""
    words = [f"w{i}" for i in range(50)]
    rows = [(0, "a " + " ".join(words) + " b"), (1, "c\n" + "\t ".join(words)), (2, " ".join(words[:49]) + " d " * 60), (3, "e " * 55), (4, "e " * 55), (5, "f " * 200)]
    found = {x.doc_id: (x.n_passages, x.n_passage_words, [(p.low, p.high) for p in x.passages]) for x in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {0: (1, 50, [(1, 51)]), 1: (1, 50, [(1, 51)]), 2: (0, 0, []), 3: (1, 55, [(0, 55)]), 4: (1, 55, [(0, 55)]), 5: (0, 0, [])}


def test_only_symbols_beside_the_core_are_matched(monkeypatch):
    """One symbol stands for a core, and only if both of its hashes agree."""
    strings = S.Strings(400, 128)
    sides, lead = [b"abcX" + b"z" * 68, b"defX" + b"z" * 68], 4
    seen = []
    monkeypatch.setattr(S, "alike", lambda data, bounds, length: seen.append((len(data), length)) or suffixes.alike(data, bounds, length))
    for checks, want in ([7, 7], 1), ([7, 8], 0):
        table = S.pa.table({"core": [5, 5], "segment": [1, 2], "side": [0, 0], "settled": [False, False], "lead": S.pa.array([lead, lead], S.pa.int32()), "label": [1, 2], "check": checks, "bytes": sides})
        found = S.match_shard(table, strings).to_pylist()
        # the strings from the fourth byte on are 1 + 1 + 68 symbols in both
        assert [(r["segment"], r["ranges"]) for r in found] == [(k, [{"low": 3, "high": 3}]) for k in (1, 2)] * want
    assert seen == [(146, 70)] * 2
    # a part's length in bytes is 400 at least
    assert strings.reach == 69


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 12))
def test_last_least(values, window):
    values = [v << 40 for v in values]
    want = [max(range(i, i + window), key=lambda k: (-values[k], k)) for i in range(len(values) - window + 1)]
    assert winnow.last_least(np.array(values, np.uint64), window).tolist() == want
