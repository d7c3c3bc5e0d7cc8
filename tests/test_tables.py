"""Checked joins fail on missing keys, projections keep names in order."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from emberline.operators import tables as T


def test_missing_keys_and_unequal_lengths_fail(spark):
    left, right = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int"), spark.createDataFrame([("a", 5)], "k string, y int")
    with pytest.raises(PySparkException, match="no row to join"):
        T.checked_join(left, right, ["k"]).collect()
    assert [tuple(r) for r in T.checked_join(left.limit(1), right, ["k"]).collect()] == [("a", 1, 5)]
    with pytest.raises(ValueError, match="both tables"):
        T.checked_join(left, right.withColumnRenamed("y", "x"), ["k"])
    with pytest.raises(ValueError, match="declared"):
        T.appended(left, right, ["k"], ["z"])
    with pytest.raises(PySparkException, match="lengths differ"):
        T.strict_zip(left.withColumn("g", F.lit(1)), right.withColumn("g", F.lit(1)).withColumnRenamed("k", "k2").withColumn("x", F.lit(0)), "g", "x").collect()
    rows = spark.createDataFrame([("/a", "f"), ("/b", "f")], "path string, file string")
    assert T.one_media(rows, "/a").first().file == "f"
    for wrong, message in (("f", "several"), ("g", "no row")):
        with pytest.raises(PySparkException, match=message):
            T.one_media(rows, wrong).collect()


def test_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "new double, a double, b double")
    assert T.aligned(df, ["b", "a"]).columns == ["b", "a"]
    with pytest.raises(ValueError, match="missing"):
        T.aligned(df, ["b", "c"])
    assert len(T.COMPACT) == 34 and len(T.GLOBAL) == 8 and len(T.OPENING) == 6 and sum(n.startswith("band_") for n in T.COMPACT) == 6
    assert T.compact_names(["event_1_history_s", "event_1_jump_db", "event_2_jump_db", "duration_s", "event_1_baseline_3_0s_db", "event_1_band_70_250_jump_db", "start_event_db"]) == ["event_1_jump_db", "duration_s", "event_1_band_70_250_jump_db", "start_event_db"]
    out = T.without_history(df.withColumnRenamed("a", "x_baseline").withColumnRenamed("b", "robust_z"), F.lit(False), ["new", "x_baseline", "robust_z"]).first()
    assert tuple(out) == (1.0, None, None)


def test_points_of_a_recording(spark):
    got = spark.range(1).select(T.proposal_points([F.lit(40 / 79), F.lit(None).cast("double"), F.lit(None).cast("double")], F.lit(0.0), F.lit(64_000)).alias("p")).first().p
    assert [tuple(x) for x in got] == [(0, 40), (3, 0)]


def test_many_prefix_rules_are_joined(spark, monkeypatch):
    from emberline.operators import labels

    rules = spark.createDataFrame([(3, "/a"), (1, "/a/b"), (2, "/a/b"), (9, ""), (4, "/é")], "rule_order int, prefix string")
    df = spark.createDataFrame([("/a/x",), ("/a/b/c",), ("/é1",), ("/a",), ("q",), (None,), ("/a/x",)], "path string")
    want = sorted((str(r.path), r.rule and r.rule.rule_order) for r in labels.prefix_rules(df, rules).collect())
    monkeypatch.setattr(labels, "FEW_RULES", 2)
    assert sorted((str(r.path), r.rule and r.rule.rule_order) for r in labels.prefix_rules(df, rules).collect()) == want
    assert dict(want) == {"/a/x": 3, "/a/b/c": 1, "/é1": 4, "/a": 3, "q": 9, "None": None}
