import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators.signal import write_wav
from emberline.plans import workflow
from emberline.sources import stores
from emberline.streaming import files


def test_mirrors_are_tried_in_order():
    seen = []

    def get(url):
        seen.append(url)
        if "b.test" in url:
            return b"ok"
        raise OSError("down")

    assert stores.fetch("https://a.test/x?y=1", ["a.test", "b.test"], get) == b"ok"
    assert seen == ["https://a.test/x?y=1", "https://b.test/x?y=1"]
    with pytest.raises(OSError, match="a.test: down; c.test: down"):
        stores.fetch("https://a.test/x", ["c.test"], get)


def test_stores(spark, tmp_path):
    empty = stores.read_or_empty(spark, str(tmp_path / "none"), stores.LABELS)
    assert empty.count() == 0 and empty.columns == ["path", "label", "note"]
    labels = spark.createDataFrame([("/a", "positive", ""), ("/b", "negative", "")], stores.LABELS)
    durations = spark.createDataFrame([("/a", 10.0, "h"), ("/b", 10.0, "h")], "path string, duration_s double, digest string")
    timings = spark.createDataFrame([("/a", "user", "h", [(1.0, 2.0)], 0.05), ("/a", "user", "old", [(1.0, 2.0)], None), ("/a", "user", "h", [], 0.0), ("/b", "user", "h", [(1.0, 2.0)], 0.0), ("/a", "model", "h", [(1.0, 2.0)], 0.0), ("/a", "user", "h", [(1.0, 2.0)], -1.0)], stores.TIMINGS)
    assert sorted(r.fault for r in stores.timing_faults(timings, labels, durations).collect()) == ["invalid error", "invalid intervals", "not a user's", "not positive", "stale"]


def test_model_and_lineage(spark, tmp_path):
    model = {"coefficient": [0.1, 0.2], "columns": ["a", "b"]}
    stores.publish_model(spark, str(tmp_path / "m"), model)
    assert stores.load_model(spark, str(tmp_path / "m")) == model
    with pytest.raises(Exception, match="exists"):
        stores.publish_model(spark, str(tmp_path / "m"), model)
    made = stores.lineage("fit", {"x": "1"}, {"c": 2})
    stores.assert_fresh(made, {"x": "1"})
    with pytest.raises(ValueError, match="stale"):
        stores.assert_fresh(made, {"x": "2"})


def test_wav_files(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(2, 500)).astype(np.float32)
    (tmp_path / "a.wav").write_bytes(write_wav(x))
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    got = stores.wav_frames(spark, str(tmp_path), 160).collect()
    assert len([r for r in got if r.error is None]) == 6 and [r.power for r in got if r.error] == [None]
    first = next(r for r in got if r.error is None and r.channel == 1 and r.frame == 2)
    assert abs(first.power - (x[1, 320:480].astype(float) ** 2).mean()) < 1e-9


def test_values_must_be_finite(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    assert stores.checked(df, ["x"]).count() == 2
    with pytest.raises(Exception, match="finite"):
        stores.checked(df.union(spark.createDataFrame([(float("nan"),)], "x double")), ["x"]).collect()


def test_workflow(spark, tmp_path):
    steps = [workflow.Step("even", lambda t: t.where("id % 2 = 0"), ("ids",)), workflow.Step("total", lambda t: t.agg(F.sum("id").alias("s")), ("even",), frozenset({"sums"}))]
    out = workflow.run(spark, steps, {"ids": spark.range(10)}, str(tmp_path / "run"))
    assert out["total"].first().s == 20 and "| 20 |" in workflow.report(out["total"], "Sums")
    with pytest.raises(Exception, match="exists"):
        workflow.run(spark, steps, {"ids": spark.range(10)}, str(tmp_path / "run"))
    assert [s.name for s in workflow.choose(steps, "other")] == ["even"] and workflow.identity(steps, {}) != workflow.identity(steps[:1], {})
    with pytest.raises(KeyError):
        workflow.run(spark, steps[1:], {})
    assert workflow.unfinished(spark.range(3).withColumnRenamed("id", "key"), spark.range(2).withColumnRenamed("id", "key")).count() == 1


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.union(events.limit(50)).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = files.landed(spark, str(tmp_path / "in"), events.schema, 1)
    once = files.drain(files.without_repeats(stream, "event_id", "10000 days"), str(tmp_path / "once"), str(tmp_path / "c1"))
    assert once.count() == once.select("event_id").distinct().count() == events.count()
    levels = files.drain(files.window_levels(stream, "1 hour", "0 seconds"), str(tmp_path / "levels"), str(tmp_path / "c2"))
    assert levels.count() > 0
    again = files.drain_totals(files.landed(spark, str(tmp_path / "in"), events.schema, 1), ["event_type"], {"n": F.count(F.lit(1))}, str(tmp_path / "t"), str(tmp_path / "c3"))
    assert again.agg(F.sum("n")).first()[0] == events.count() + 50
