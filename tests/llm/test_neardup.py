import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from emberline.llm import common
from emberline.llm import neardup as N
from emberline.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, width, percent=80):
    """Components over all pairs, found by an inverted index of shingles."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in holders.get(x, ()):
                shared[j] = shared.get(j, 0) + 1
            holders.setdefault(x, []).append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(k, least.get(root(i), k))
    return sorted((k, len(sets[i]), least[root(i)]) for i, (k, _) in enumerate(rows))


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, node string").repartition(5)


def got(df, width):
    out = N.near_duplicates(df, width=width).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in out)


def near_copies():
    """Copies of a base, each with edits of its own: alike with the base, less so with each other."""
    r = random.Random(3)
    base = [f"w{r.randint(0, 400)}" for _ in range(300)]
    rows = []
    for i in range(250):
        w = list(base)
        for _ in range(r.choice([0, 2, 4, 6, 8, 10, 12])):
            w[r.randrange(len(w))] = f"x{r.randint(0, 9999)}"
        rows.append(" ".join(w))
    chain = [f"c{i}" for i in range(200)]
    for i in range(40):
        rows.append(" ".join(chain[3 * i :] + [f"d{j}" for j in range(3 * i)]))
    return rows


def test_matches_brute_force(spark):
    texts = [None, "", " ", "a", "A", "a b", "a b c", "A B c", "a b c d", "É é x", "é é x"] + near_copies()
    texts += pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    order = random.Random(5).sample(range(len(texts)), len(texts))
    rows = [(7 * order[i], t) for i, t in enumerate(texts)]
    rows.append(rows[20])
    for width in (4, 5):
        assert got(frame(spark, rows), width) == brute(rows, width)


def test_blocks_find_what_hubs_miss(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 64)
    monkeypatch.setattr(N, "EXACT_BLOCK", 32)
    rows = [(i, t) for i, t in enumerate(near_copies())]
    assert got(frame(spark, rows), 4) == brute(rows, 4)


def test_heavy_buckets_and_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 5)
    monkeypatch.setattr(N, "BLOCK", 16)
    rows = [(i, t) for i, t in enumerate(near_copies())]
    assert got(frame(spark, rows), 4) == brute(rows, 4)


def test_recall_just_above_the_threshold(spark):
    """Pairs at 0.80 to 0.85: nine of ten at least are asked for, all but 3e-6 expected."""
    r = random.Random(11)
    rows, want = [], set()
    for i in range(600):
        base = [f"p{i}w{k}" for k in range(r.randint(80, 400))]
        other = list(base)
        for at in r.sample(range(4, len(base) - 4, 4), max(1, len(base) // 40)):
            other[at] = "changed"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
        a, b = shingles(rows[-2][1], 4), shingles(rows[-1][1], 4)
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            want.add((2 * i, 2 * i + 1))
    groups = {k: c for k, _, c in got(frame(spark, rows), 4)}
    assert len(want) > 150 and sum(groups[a] == groups[b] for a, b in want) >= 0.99 * len(want)


def test_empty(spark):
    assert got(frame(spark, [(1, None)]).limit(0), 4) == []
    assert got(frame(spark, [(1, None), (2, None), (3, "")]), 4) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_estimate_is_unbiased():
    r = np.random.default_rng(1)
    sets = np.unique(r.integers(0, 2**63, 3000, dtype=np.uint64))
    a, b = sets[:2000], sets[500:2500]
    least = N.minima(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    x, y = (N.signatures(least)[i].view(np.uint64) for i in (0, 1))
    d = x ^ y
    same = N.PERMUTATIONS - int(np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum())
    assert abs(N.estimate(same) - 0.6) < 0.15


def test_shingle_hashes_match_sets():
    texts = ["a b c d e", "A b C d E", "a  b\tc d\x0be", None, "x", "É b c d", "é b c d"]
    sets, bounds = N.shingle_sets(pa.array(texts), 4)
    own = [set(sets[a:b].tolist()) for a, b in zip(bounds, bounds[1:], strict=False)]
    assert own[0] == own[1] == own[2] and len(own[0]) == 2 and own[3] == set() and own[5] != own[6]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, 7)]
    out = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in out} == {i: i // 20 * 20 for i in range(60)} | {100: 0}
