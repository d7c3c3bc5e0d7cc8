import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from emberline.llm.bpe import NO_PAIR, WIDEST, Codec, PairTree, bpe_decode, bpe_digests, bpe_round_trip, merge_pairs

from .test_tokens import texts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return Codec(PATH)


def equal(codec, library, some):
    for text, (ids, decoded) in zip(some, codec.encode(some), strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, np.int32).tolist() == want, text
        assert decoded == library.decode(want, skip_special_tokens=False), text


def test_equals_the_library(codec, library):
    equal(codec, library, texts())
    r = random.Random(7)
    letters = ["abcdefghij", "ABCDEÀÉÎÖÜßſıİŉĸ", "etaoin", "'sdlvrem ", "日本語 ́‍👩", "<|endoftext|>", "0123½²", "\x00\x7f\xad﻿\x1c\x85"]
    equal(codec, library, ["".join(r.choice(r.choice(letters)) for _ in range(r.randint(0, 90))) for _ in range(1500)])


def test_widths_of_trees(codec, library):
    equal(codec, library, ["".join(random.Random(n).choices("eaintr", k=n)) for n in [*range(1, 140), 5000]])


def test_pair_tree_is_the_least_pair():
    r = random.Random(3)
    for n in (0, 1, 2, 5, 8, 13):
        keys = [r.randint(0, 50) for _ in range(n)]
        tree = PairTree(keys)
        for _ in range(40):
            assert tree.least() == min(keys, default=NO_PAIR)
            if n:
                at = r.randrange(n)
                keys[at] = r.choice([NO_PAIR, r.randint(0, 50)])
                tree.put(at, keys[at])


def test_merges_against_repeated_search():
    r = random.Random(4)
    for _ in range(300):
        pairs = {}
        for rank in range(r.randint(1, 12)):
            pairs.setdefault((r.randint(0, 3 + rank // 2), r.randint(0, 3 + rank // 2)), (rank, 4 + rank))
        ids = [r.randint(0, 3) for _ in range(r.randint(0, WIDEST))]
        want = list(ids)
        while found := [(pairs[p][0], i) for i, p in enumerate(zip(want, want[1:])) if p in pairs]:
            i = min(found)[1]
            want[i : i + 2] = [pairs[want[i], want[i + 1]][1]]
        assert merge_pairs(ids, pairs) == want


def test_frame(spark, library):
    df = spark.createDataFrame([(1, "Ça va", "x", 5), (1, "Ça va", "x", 5), (None, None, None, None), (2, "", "y", 6), (3, "a <|endoftext|>b", "z", 7), (4, "x" * 30000, "z", 7)], "doc_id long, text string, _text string, n_tokens long")
    out = bpe_round_trip(df)
    assert out.columns == ["doc_id", "_text", "n_tokens", "ids", "decoded"]
    rows = out.collect()
    assert sorted((r.doc_id or 0, r._text or "", r.decoded) for r in rows)[:4] == [(0, "", ""), (1, "x", "Ã§a</w> va</w>"), (1, "x", "Ã§a</w> va</w>"), (2, "y", "")]
    assert {r.doc_id: r.ids for r in rows}[4] == library.encode("x" * 30000, add_special_tokens=False).ids
    assert all(r.decoded == s.decoded for r, s in zip(sorted(rows, key=str), sorted(bpe_decode(out.withColumnRenamed("decoded", "d")).collect(), key=str), strict=True))
    digests = {r.doc_id: r for r in bpe_digests(bpe_round_trip(df, keep=["doc_id"]), ["doc_id"]).collect()}
    assert digests[3].n_tokens == 3 and digests[2].decoded_sha256 == hashlib.sha256(b"").hexdigest() == digests[2].ids_sha256
    assert digests[3].ids_sha256 == hashlib.sha256(" ".join(map(str, library.encode("a <|endoftext|>b", add_special_tokens=False).ids)).encode()).hexdigest()
    assert bpe_round_trip(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        bpe_round_trip(df.withColumnRenamed("_text", "Ids"), keep=["Ids"])


def test_query_equals_the_library(spark, library):
    from emberline.llm.queries import op13_bpe_codec

    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op13_bpe_codec(spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        ids = library.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
