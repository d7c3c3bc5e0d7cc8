import datetime
import random

import numpy as np
import pytest

from emberline.llm.persistent import PersistentForest
from emberline.llm.rolling import rolling_users

SCHEMA = "click_id long, ts timestamp_ntz, client_id long, kind string, k int, n long"
WINDOWS, HOT = {"short": 3, "middle": 10, "long": 40}, ("hot", 3, 40)


def at(minute, second=0):
    return datetime.datetime(1970, 1, 1) + datetime.timedelta(minutes=minute, seconds=second)


def brute(rows, windows=WINDOWS, hot=HOT):
    clicks = {}
    for i, ts, user, kind, *_ in rows:
        if ts is not None and kind is not None:
            m = (ts - at(0)) // datetime.timedelta(minutes=1)
            key = ("null", len(clicks)) if i is None else i
            clicks[key] = min(clicks.get(key, (m, kind, user is None, user)), (m, kind, user is None, user), key=lambda c: (c[0], c[1], c[2], c[3] or 0))
    out = set()
    for kind, m in {(c[1], c[0]) for c in clicks.values()}:
        def users(length):
            return [c[3] for c in clicks.values() if c[1] == kind and m - length < c[0] <= m and c[3] is not None]

        of = users(hot[2])
        out.add((kind, m, *(len(set(users(w))) for w in windows.values()), sum(of.count(u) >= hot[1] for u in set(of))))
    return out


def test_forest_against_counts():
    rng = np.random.default_rng(1)
    for _ in range(60):
        groups, bits, n = int(rng.integers(1, 5)), int(rng.integers(1, 6)), int(rng.integers(0, 60))
        g, m, p, c = rng.integers(0, groups, n), rng.integers(0, 32, n), rng.integers(0, 1 << bits, n), rng.integers(-2, 3, n)
        forest = PersistentForest(groups, bits, g, m, p, c, 32)
        asked = rng.integers(0, groups, 50), rng.integers(0, 32, 50), rng.integers(0, 1 << bits, 50)
        assert forest.suffix(*asked).tolist() == [int(c[(g == a) & (m <= b) & (p >= s)].sum()) for a, b, s in zip(*asked)]


@pytest.mark.parametrize("block,shard_rows", [(5760, 20000), (7, 10), (40, 3)])
def test_against_brute_force(spark, block, shard_rows):
    r = random.Random(block)
    rows = []
    for i in range(900):
        # one user with a third of the clicks, many at the same minute; times before 1970 too
        minute = r.choice([r.randint(-100, 400), 17, 18])
        user = 1 if r.random() < 0.33 else r.choice([None, *range(2, 30)])
        rows.append((i, at(minute, r.randint(0, 59)), user, r.choice(["view", "view", "view", "click", "", None]), 0, 0))
    rows += r.sample(rows, 40) + [(None, at(5), 7, "view", 1, 1)] * 3 + [(2000, None, 7, "view", 1, 1), (2001, at(900), None, "sale", 1, 1), (2002, at(950), 3, "view", 0, 0), (2002, at(949), 4, "view", 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = rolling_users(df, WINDOWS, HOT, block=block, shard_rows=shard_rows)
    assert got.columns == ["kind", "minute", "short", "middle", "long", "hot"]
    found = [tuple(x) for x in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows)


def test_empty_zone_and_other_types(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rolling_users(empty, WINDOWS, HOT).count() == 0
    rows = [("a", at(3), "u", "x"), ("b", at(4), "v", "x"), ("b", at(4), "v", "x"), ("c", at(7), None, "x")]
    df = spark.createDataFrame(rows, "ident string, at timestamp_ntz, who string, what string")
    want = {("x", 3, 1, 1, 1, 0), ("x", 4, 2, 2, 2, 0), ("x", 7, 0, 2, 2, 0)}
    for frame in (df, df.selectExpr("ident", "to_utc_timestamp(cast(at as timestamp), current_timezone()) at", "who", "what")):
        got = rolling_users(frame, WINDOWS, HOT, "ident", "at", "who", "what")
        assert {tuple(x) for x in got.collect()} == want
