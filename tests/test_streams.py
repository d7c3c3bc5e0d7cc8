"""Stateful streams against their batch forms, and companions that stop together."""

import datetime
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators.signal import weighted
from emberline.plans.workflow import CompanionError, companions
from emberline.streaming import ordered

BLOCKS = "clip string, block long, samples array<double>"


def feed(spark, folder, parts, schema):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))


def drained(df, name, folder):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination()
    return query, df.sparkSession.table(name).collect()


def test_shuffled_blocks_equal_the_whole_filter(spark, tmp_path):
    g = np.random.default_rng(1)
    clips = {c: g.normal(size=(n, 160)) * 0.1 for c, n in (("a", 12), ("b", 7), ("c", 1))}
    rows = [(c, k, x.tolist()) for c, xs in clips.items() for k, x in enumerate(xs)]
    random.Random(2).shuffle(rows)
    rows += rows[:3]  # some come again
    stream = feed(spark, tmp_path / "in", [rows[k::5] for k in range(5)], BLOCKS)
    _, got = drained(ordered.ordered_levels(stream), "levels", str(tmp_path / "state"))
    found = {(r.clip, r.block): r.level for r in got}
    assert len(found) == len(got) == 20 and not any(r.waiting for r in got)
    for c, xs in clips.items():
        power = (weighted(xs.reshape(1, -1)).reshape(-1, 160) ** 2).mean(axis=1)
        assert [found[c, k] for k in range(len(xs))] == pytest.approx(np.maximum(-90, -0.691 + 10 * np.log10(power)).tolist(), abs=1e-9)
    # in order for each clip
    assert all([r.block for r in got if r.clip == c] == sorted(r.block for r in got if r.clip == c) for c in clips)


def test_a_gap_is_named_and_filled_later(spark, tmp_path):
    stream = feed(spark, tmp_path / "in", [[("a", 1, [0.5] * 160), ("a", 2, [0.5] * 160)]], BLOCKS)
    query = ordered.ordered_levels(stream, 500).writeStream.format("memory").queryName("gap").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        end = time.time() + 60
        while time.time() < end and not spark.table("gap").where("waiting").count():
            time.sleep(0.5)
        assert {(r.clip, r.block) for r in spark.table("gap").where("waiting").collect()} == {("a", 0)}
        spark.createDataFrame([("a", 0, [0.5] * 160)], BLOCKS).coalesce(1).write.parquet(str(tmp_path / "in/later"))
        while time.time() < end and spark.table("gap").where("not waiting").count() < 3:
            time.sleep(0.5)
        assert [r.block for r in spark.table("gap").where("not waiting").collect()] == [0, 1, 2]
    finally:
        query.stop()


def test_sessions_merge_and_late_rows_are_counted(spark, tmp_path):
    def at(minute):
        return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)

    schema = "user long, ts timestamp"
    # two sessions of one user that a third row joins later; a row far too late, which a batch sees by the
    # watermark that the one before it began with; rows that end all
    parts = [[(1, at(0)), (1, at(40)), (2, at(10))], [(1, at(20)), (2, at(10))], [(3, at(600))], [(3, at(601))], [(2, at(5))], [(3, at(1200))], [(3, at(1201))]]
    stream = feed(spark, tmp_path / "in", parts, schema)
    query, got = drained(ordered.sessions(stream, "user", "ts"), "sessions", str(tmp_path / "state"))
    found = {(r.user, r.start, r.end, r.events) for r in got}
    assert found == {(1, at(0), at(70), 3), (2, at(10), at(40), 2), (3, at(600), at(631), 2)}
    assert ordered.dropped_late(query) == 1


def test_companions(spark):
    def slow(session):
        return session.range(8, numPartitions=8).mapInArrow(lambda batches: (time.sleep(25) or b for b in batches), "id long").count()

    def broken(session):
        # the other's tasks hold all slots by now, so this one starts no job
        end = time.time() + 20
        while time.time() < end and not session.sparkContext.statusTracker().getActiveJobsIds():
            time.sleep(0.1)
        raise ValueError("no")

    assert companions(spark, {"a": lambda s: s.range(5).count(), "b": lambda s: s.range(7).count()}) == {"a": 5, "b": 7}
    assert companions(spark, {}) == {}
    began = time.time()
    with pytest.raises(CompanionError, match="second failed") as caught:
        companions(spark, {"first": slow, "second": broken})
    assert caught.value.name == "second" and time.time() - began < 20


def test_companions_stop_streams(spark, tmp_path):
    schema = "x long"

    def endless(session):
        stream = feed(session, tmp_path / "in", [[(1,)]], schema)
        session_query = stream.writeStream.format("memory").queryName("endless").option("checkpointLocation", str(tmp_path / "state")).start()
        session_query.awaitTermination()
        return "stopped"

    def broken(session):
        end = time.time() + 60
        while time.time() < end and not any(q.name == "endless" for q in session.streams.active):
            time.sleep(0.2)
        raise ValueError("no")

    with pytest.raises(CompanionError, match="b failed"):
        companions(spark, {"a": endless, "b": broken})
    assert not any(q.name == "endless" for q in spark.streams.active)
