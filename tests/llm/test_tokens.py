import random

import public_tokenizers
import pyarrow as pa

from emberline.llm.tokens import ByteIds, WholeTokens, token_counts

PARTS = ["a", "b", "The", " ", "  ", "\n", "'s", "'", "1", "é", "́", "\t", "!", "#*", "ß", "Σ", " ", "日", "\x0b", "<|endoftext|>", "\r\n", "​"]
EDGE = ["", None, " ", "it's 'Twas they'll I'M", "<|endoftext|> a <|startoftext|>", "１２３ 12345", "ΑΣ ΟΔΟΣ", "İstanbul ſ", "👨‍👩‍👧", " \x00 a\x00b", "ﬁ", "x" * 20000]


def texts():
    r = random.Random(1)
    return EDGE + ["".join(r.choice(PARTS) for _ in range(r.randint(1, 14))) for _ in range(1500)]


def test_counts_equal_the_library():
    counter = WholeTokens(public_tokenizers.path("word_bpe_49k.json"))
    want = [len(counter.library.encode(t or "", add_special_tokens=False).ids) for t in texts()]
    assert counter.counts(pa.array(texts(), pa.string())).tolist() == want
    # the proof: a whole pre-token is one token to the library
    some = random.Random(2).sample(sorted(counter.whole), 500)
    for s in some:
        if counter.normalise(s) == s and counter.split(s) == [s]:
            assert len(counter.library.encode(s, add_special_tokens=False).ids) == 1


def test_ids_equal_the_library():
    ids = ByteIds("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    for t in texts():
        assert ids(t) == ids.library.encode(t or "", add_special_tokens=False).ids


def test_frame(spark):
    df = spark.createDataFrame([(1, "é a", 5), (1, "é a", 5), (2, None, 6), (3, "w " * 2049, 7)], "doc_id long, text string, n_bytes long")
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df).collect())
    assert got == [(1, 4, 2, False), (1, 4, 2, False), (2, 0, 0, False), (3, 4098, 2049, True)]
    assert token_counts(df.limit(0)).count() == 0


def test_clashing_columns_and_repeated_rows(spark):
    from emberline.llm.tokens import token_counts

    df = spark.createDataFrame([(1, "one two", "x", 5), (1, "one two", "x", 5), (None, None, None, None), (2, "", "y", 6)], "doc_id long, text string, _text string, words long")
    got = sorted(((r.doc_id or 0, r._text, r.n_bytes) for r in token_counts(df).collect()), key=str)
    assert got == sorted([(1, "x", 7), (1, "x", 7), (0, None, 0), (2, "y", 0)], key=str)
    assert token_counts(df.limit(0)).count() == 0
