import re
from collections import defaultdict

from pyspark.sql import functions as F

from emberline.llm.mixing import emit_copies, mix_sources

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shares(sizes, weights=(5, 2, 1), most=3.0):
    """Targets by resharing until none is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, open_, fixed = sum(sizes.values()), set(names), {}
    while open_:
        level = (total - sum(fixed.values())) / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not above:
            break
        fixed |= {s: most * sizes[s] for s in above}
        open_ -= above
    return fixed | {s: level * weight[s] for s in open_}


def rows():
    out = []
    for i in range(900):
        source = ["a", "b", "é", None, "z", "tiny"][0 if i % 3 == 0 else i % 5]
        out.append((i, " ".join(["w"] * (1 + i * 7 % 90)), source, "x"))
    out += [(900, None, "a", "x"), (901, "", "a", "x"), (902, "one two", "tiny", "x"), (902, "one two", "tiny", "x"), (903, None, "empty", None)]
    return out


def test_targets_and_copies(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, source string, size string").repartition(5)
    got = mix_sources(df).collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, len(WORD.findall(t or ""))) for i, t, _, _ in data)
    sizes = defaultdict(int)
    for _, t, s, _ in data:
        sizes[s] += len(WORD.findall(t or ""))
    want = shares(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    for s, x in want.items():
        assert abs(taken[s] - x) <= 200, (s, taken[s], x)
    again = mix_sources(df.repartition(3)).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert emit_copies(mix_sources(df)).agg(F.sum("size")).first()[0] == sum(taken.values())


def test_empty(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
