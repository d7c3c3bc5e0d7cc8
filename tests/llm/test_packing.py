import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.llm.packing import nnls, pack_sequences, plan


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 1023), max_size=300))
def test_plan_holds_each_id_once_with_little_padding(lengths):
    got = plan(np.array(lengths, np.int64))
    parts = defaultdict(list)
    padding = 0
    for s in got:
        n = sum(x for *_, x in s)
        assert 0 < n <= 1024 and all(x > 0 for *_, x in s)
        padding += 0 if n & (n - 1) == 0 else 1024 - n
        for t, a, x in s:
            parts[t].append((a, x))
    for t, n in enumerate(lengths):
        at = 0
        for a, x in sorted(parts[t]):
            assert a == at
            at += x
        assert at == n
    # gaps of the classes alone can stay open, and only when nothing is left to fill them
    assert padding <= 3 * 16 * len(got)


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(1)
    a, b = rng.random((20, 35)), rng.random(20) * 10
    x = nnls(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and (slope < 1e-6).all() and np.abs(slope[x > 0]).max() < 1e-6


def test_round_trip(spark):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", "a", "<|endoftext|> x", "é b", "word " * 3000, " ".join(f"w{i}" for i in range(700)), "same text", "same text"]
    texts += [" ".join(["lorem", "ipsum", "dolor"][(i + j) % 3] for j in range(i * 37 % 900)) for i in range(150)]
    rows = [(min(i, len(texts) - 2), t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length long").repartition(4)
    got = pack_sequences(df).collect()
    want = defaultdict(list)
    for i, t, _ in rows:
        want[i].append(library.encode(t or "", add_special_tokens=False).ids + [0])
    held, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        held[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert set(held) == set(want)
    for i, docs in want.items():
        assert sum(r.length for r in held[i]) == sum(map(len, docs))
        for r in held[i]:
            assert any(len(d) == r.doc_tokens and zlib.crc32(np.array(d[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for d in docs)
    assert pack_sequences(df.limit(0)).count() == 0
