"""Contents grouped with and without contradictions."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from emberline.operators import labels, metrics

SCHEMA = "digest string, label string, path string, thread string, timed boolean, intervals array<struct<start_s:double,end_s:double>>"
ROWS = [
    ("a", "positive", "/p/2", "2", True, [(1.0, 2.0)]), ("a", "unlabeled", "/p/1", "1", False, None), ("a", "positive", "/p/3", "2", True, [(1.0, 2.0)]),
    ("b", "unlabeled", "/p/9", "7", False, None), ("c", "negative", "/p/5", "3", False, None), ("c", "visual-only", "/p/4", "1", False, None), ("d", "visual-only", "/p/6", "1", False, None),
]


def test_contents(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.digest: (r.path, r.label, r.timed, r.fold_thread, r.threads) for r in labels.group_contents(df, intervals="intervals").collect()}
    assert got == {"a": ("/p/2", "positive", True, "1", 2), "b": ("/p/9", "unlabeled", False, "7", 1), "c": ("/p/5", "negative", False, "3", 1)}
    assert labels.group_contents(df.where("false")).collect() == []


@pytest.mark.parametrize(("row", "what"), [(("c", "positive", "/p/7", "3", False, None), "labels of c"), (("a", "unlabeled", "/p/7", "3", True, [(1.0, 2.5)]), "timings of a")])
def test_contradictions(spark, row, what):
    df = spark.createDataFrame([*ROWS, row], SCHEMA)
    with pytest.raises(PySparkException, match=f"conflicting {what}"):
        labels.group_contents(df, intervals="intervals").collect()
    flagged = labels.group_contents(df, intervals="intervals", strict=False).where("conflict OR timing_conflict").collect()
    assert [r.digest for r in flagged] == [what[-1]]


def test_bootstrap_joins_alike(spark, monkeypatch):
    rows = spark.range(900).select((F.col("id") % 60).alias("thread"), F.when(F.col("id") % 3 == 0, "positive").otherwise("negative").alias("label"), (F.col("id") * 7 % 100 / 100.0).alias("before"), (F.col("id") * 11 % 100 / 100.0).alias("after"))
    few = metrics.cluster_bootstrap(rows, "thread", draws=40).first()
    monkeypatch.setattr(metrics, "FEW_CLUSTERS", 10)
    monkeypatch.setattr(metrics, "PICKS", 100)
    assert metrics.cluster_bootstrap(rows.repartition(7), "thread", draws=40).first() == few
    assert metrics.cluster_bootstrap(rows.where("false"), "thread", draws=40).first().draws == 0
