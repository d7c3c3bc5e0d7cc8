"""Landmark queries with slack against the reference's look-up, in plain Python."""

from collections import Counter, defaultdict

from emberline.operators import matching
from emberline.queries import QUERIES, evidence

DIR = "/root/testdata/sf0.001"


def test_queries_look_one_step_beside(spark):
    refs = [(r.reference, r.token, r.frame) for r in evidence.postings(spark, DIR, "benchmark", "item_id", "reference").collect()]
    often = Counter(t for _, t, _ in refs)
    at = defaultdict(list)
    for reference, token, frame in refs:
        if often[token] <= matching.COMMON:
            at[token].append((reference, frame))
    found = defaultdict(set)
    equal = 0
    for q in evidence.postings(spark, DIR, "documents", "doc_id", "query").collect():
        for d in (-1, 0, 1):
            if 0 <= (q.token & 511) + d < 512:
                for reference, frame in at[q.token + d]:
                    found[q.query, reference].add((frame, q.frame, q.token + d))
                    equal += d == 0
    got = {(r.query, r.reference): (r.hits, r.tokens) for r in QUERIES["inverted_index_match"](spark, DIR).collect()}
    assert got == {k: (len(v), len({t for _, _, t in v})) for k, v in found.items()}
    assert sum(n for n, _ in got.values()) > equal
    modes = defaultdict(dict)
    for r in QUERIES["offset_mode"](spark, DIR).collect():
        modes[r.query, r.reference][r["rank"]] = (r.bucket, r.hits)
    for k, v in found.items():
        most = sorted(Counter(round((a - f) / 3) for f, a, _ in v).items(), key=lambda x: (-x[1], x[0]))[:3]
        assert modes[k] == dict(enumerate(most, 1))
    assert sum(r.matched for r in QUERIES["match_summary"](spark, DIR).collect()) == len({q for q, _ in found})
    frames = defaultdict(set)
    for reference, _, frame in refs:
        frames[reference].add(frame)
    want = {}
    for (query, reference), v in found.items():
        best = None
        for rank in sorted(modes[query, reference]):
            bucket, _ = modes[query, reference][rank]
            near = [(f, t) for f, a, t in v if abs(a - f - 3 * bucket) <= 3]
            places, tokens = {f for f, _ in near}, {t for _, t in near}
            share, wide = len(places) / len(frames[reference]), (max(places) - min(places)) / 100 if places else 0
            if len(places) >= 6 and len(tokens) >= 8 and len({t >> 18 for t in tokens}) >= 3 and share >= 0.25 and wide >= min(0.15, 0.003 * len(frames[reference])) and (best is None or len(places) > best[1]):
                best = (bucket, len(places), len(tokens))
        if best:
            want[query, reference] = best
    assert want and {(r.query, r.reference): (r.bucket, r.anchors_hit, r.tokens_hit) for r in QUERIES["match_accept"](spark, DIR).collect()} == want
