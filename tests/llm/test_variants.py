import random
import re
import zlib
from collections import Counter

import pytest

from emberline.llm.variants import near_pairs, place, spelling_variants

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, every=199, shortest=6, least=5, ratio=5):
    total = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    words = {w: n for w, n in total.items() if len(w) >= shortest and n >= least}
    around = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, vs in around.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= ratio * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(around[w]), words.get(form.get(w))) for w, n in words.items()}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n long")


def found(spark, rows, **options):
    got = [tuple(r) for r in spelling_variants(frame(spark, rows), **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_pairs_of_a_block_once():
    r = random.Random(2)
    for _ in range(40):
        words = list({"".join(r.choices("abc", k=r.choice([6, 7]))) for _ in range(60)})
        got = list(near_pairs(words, 6, 0, 6))
        want = {frozenset((a, b)) for a in words for b in words if near(a, b) and 6 in (len(a), len(b))}
        assert len(got) == len(want) and {frozenset(p) for p in got} == want
    assert place("aab", "aaab", 0, 3) == 2 and place("aab", "aaab", 0, 1) == -1 and place("aab", "aabb", 2, 3) == 3


@pytest.mark.parametrize("block", [2000, 12])
def test_against_brute_force(spark, block):
    r = random.Random(block)
    stems = ["".join(r.choices("abéÀ", k=r.randint(5, 9))) for _ in range(40)] + ["gemeinsam" + c for c in "abcdefghijklmnopqrst"] + [c + "zusammen" for c in "abcdefghijklmnopqrst"]
    weights = [r.choice([1, 1, 5, 30, 200]) for _ in stems]

    def word():
        w = r.choices(stems, weights)[0]
        i = r.randrange(len(w))
        return r.choice([w, w, w, w[:i] + w[i + 1 :], w[:i] + r.choice("abéÀZ") + w[i:], w[:i] + "b" + w[i + 1 :], w.upper()])

    rows = [(i // 2, " ".join(word() for _ in range(200))) for i in range(60)] + [(None, "Ähnlich " * 7), (None, None), (7, ""), (8, "1 2 3"), (9, ("langeswort" * 400 + " ") * 6 + ("langeswort" * 400 + "e ") * 40)]
    rows += [(10, "kettenx " * 5 + "kettenxy " * 25 + "kettenxyz " * 130)]
    got = found(spark, rows, block=block)
    assert got == brute(rows)
    assert any(g[1] and g[2] != g[1] for g in got) and any(g[4] > 12 for g in got)


def test_more_blocks_than_are_sent_to_all(spark, monkeypatch):
    monkeypatch.setattr("emberline.llm.common.FEW", 1)
    rows = [(i, " ".join(f"vorne{a}{b}hinten" for a in "abcdefg" for b in "abcdefg")) for i in range(6)]
    assert found(spark, rows, block=5) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == set()
    assert found(spark, [(1, "kurz und gut")]) == set()


def test_query_against_brute_force(spark):
    from emberline.llm.queries import op11_spelling_variants

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in op11_spelling_variants(spark, sf).collect()} == brute(rows)
