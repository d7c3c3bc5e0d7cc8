import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tokenizers

import corpus_pipeline as C

from .test_neardup import brute as near_brute
from .test_quality import brute as quality_brute

DIR = "/root/testdata/sf0.001"


def plain(df):
    return [tuple(r) for r in df.collect()]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    extra = docs.limit(3)
    docs = docs.union(extra)
    rows = plain(docs)
    columns = docs.columns
    t = columns.index("text")

    good = C.quality(spark, docs, DIR)
    want = [r for r in rows if quality_brute(r[t])[-1]]
    assert Counter(plain(good)) == Counter(want) and good.columns == columns

    one = C.near_dups(spark, good, DIR)
    groups = near_brute([(r[0], r[t]) for r in want], 5)
    assert Counter(r[0] for r in plain(one)) == Counter({c for _, _, c in groups}) and one.columns == columns

    clean = C.secrets(spark, one, DIR)
    before = {r[0]: r for r in plain(one)}
    for r in plain(clean):
        old = before.pop(r[0])
        assert r[1] == old[1] or ("<" in r[t] and r[-1] == len(r[t]))
    assert not before

    mixed = C.mixing(spark, clean, DIR)
    held = {r[0]: r for r in plain(clean)}
    times = Counter(r[0] for r in plain(mixed))
    assert max(times.values()) <= 3 and all(held[r[0]] == r for r in plain(mixed))
    words = lambda r: len(r[t].split())
    total = sum(words(r) for r in held.values())
    assert abs(sum(words(held[k]) * n for k, n in times.items()) - total) < 0.15 * total

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {k: library.encode(held[k][t], add_special_tokens=False).ids + [0] for k in times}
    tokens = defaultdict(int)
    for r in C.packing(spark, mixed, DIR).collect():
        tokens[r.doc_id] += r.length
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert tokens == {k: n * len(ids[k]) for k, n in times.items()}


def test_edges(spark):
    rows = [(1, None, "en", "a", 0), (1, None, "en", "a", 0), (None, "", None, None, None), (2, " ".join(f"w{i}" for i in range(60)), "en", None, 1)]
    rows += [rows[-1], (2, " ".join(f"v{i}" for i in range(70)), "en", None, 1), (3, " ".join(f"u{i}" for i in range(55)) + " token = 0a1b2c3d4e5f60718293a4b5c6d7", None, "b", 7)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in C.STAGES:
            assert stage(spark, start, DIR).count() >= 0
            now = stage(spark, now, DIR)
            if name == "near_dups":
                assert now.count() == (3 if start is docs else 0)
            if name == "secrets" and start is docs:
                assert [r.text[-9:] for r in now.collect() if r.doc_id == 3] == [" <assign>"]
        assert (now.count() > 0) == (start is docs)


def test_run(spark):
    assert C.run(spark, DIR).count() > 0
