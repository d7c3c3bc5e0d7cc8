"""The store of labels and timings, its command line, and checks of matches and models."""

import pytest
from pyspark.sql import functions as F

from emberline.__main__ import main, parser
from emberline.operators import matching, models
from emberline.plans import labelling

SNAPSHOT = [("/t/1/a.mp4", "a.mp4"), ("/t/1/b.mp4", "b.mp4"), ("/t/2/b.mp4", "b.mp4"), ("/t/1/c.mp4", "c.mp4")]


def labels_of(spark, store):
    return {r.path: r.label for r in labelling.read(spark, store, "labels").collect()}


def test_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spark, "stop", lambda: None)
    store, shot, media = (str(tmp_path / n) for n in ("store", "shot", "media"))
    spark.createDataFrame(SNAPSHOT, "path string, file string").write.parquet(shot)
    spark.createDataFrame([(*r, f"d{k}", 20.0) for k, r in enumerate(SNAPSHOT)], "path string, file string, digest string, duration_s double").write.parquet(media)
    with pytest.raises(SystemExit, match="begin with init"):
        main(["add", store, shot])
    main(["init", store])
    with pytest.raises(SystemExit, match="holds labels"):
        main(["init", store])
    for name in ("b.mp4", "typo.mp4"):
        with pytest.raises(SystemExit, match=f"{name} names"):
            main(["add", store, shot, "--positive", "a.mp4", "--positive", name])
    assert labels_of(spark, store) == {}
    main(["add", store, shot, "--positive", "a.mp4", "--positive", "/t/2/b.mp4"])
    want = {"/t/1/a.mp4": "positive", "/t/1/b.mp4": "negative", "/t/2/b.mp4": "positive", "/t/1/c.mp4": "negative"}
    assert labels_of(spark, store) == want
    # a later review names no more of them; what has a label keeps it
    main(["add", store, shot, "--positive", "c.mp4"])
    assert labels_of(spark, store) == {**want, "/t/1/c.mp4": "positive"}
    main(["timings", store, media, "a.mp4", "--interval", "1.2:end", "--error", "0.1"])
    main(["timings", store, media, "a.mp4", "--interval", "1:2", "--interval", "3:4.5"])
    row = labelling.overview(spark, store).where("path = '/t/1/a.mp4'").first()
    assert [tuple(i) for i in row.intervals] == [(1.0, 2.0), (3.0, 4.5)] and row.error_s == 0.1
    assert labelling.overview(spark, store).count() == 3
    for bad, why in ((["a.mp4", "--interval", "5:4"], "invalid intervals"), (["/t/1/b.mp4", "--interval", "1:2"], "not positive"), (["c.mp4", "--interval", "1:2", "--error", "-1"], "not negative")):
        with pytest.raises(SystemExit, match=why):
            main(["timings", store, media, *bad])
    # a table without its marker is one that a lost job left
    labelling.read(spark, store, "labels").where("false").write.parquet(f"{store}/labels/9")
    (tmp_path / "store" / "labels" / "9" / "_SUCCESS").unlink()
    assert labels_of(spark, store)["/t/1/a.mp4"] == "positive"


def test_what_the_command_line_refuses(capsys):
    for wrong in ([], ["run", "detect"], ["run", "detect", "x", "--explain", "--output", "y"], ["timings", "s", "m", "n"], ["nothing"]):
        with pytest.raises(SystemExit) as stop:
            parser().parse_args(wrong)
        assert stop.value.code == 2
    for wrong in (["run", "no_such_query", "x"], ["train", "t", "m", "--family", "none"]):
        with pytest.raises(SystemExit, match="^no "):
            main(wrong)
    main(["list"])
    assert "detect\n" in capsys.readouterr().out


def test_evaluation(spark):
    queries = spark.createDataFrame([(1, "negative", "a"), (2, "negative", "b"), (3, "positive", "c"), (4, "positive", "d"), (5, None, "e"), (6, "negative", "f")], "query long, label string, digest string")
    matches = spark.createDataFrame([(1, "x", False), (1, "y", True), (2, "b", True), (3, "c", True), (4, "x", None), (5, "x", True), (6, "x", False)], "query long, reference_digest string, confirmed boolean")
    assert tuple(matching.evaluation(queries, matches).first()) == (3, 2, 1, 2, 1)
    assert tuple(matching.evaluation(queries.where("false"), matches).first()) == (0, 0, 0, 0, 0)
    changed = spark.createDataFrame([(1, "u", "a"), (2, "u", "b"), (1, "v", "a")], "query long, variant string, digest string")
    hits = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (2, "u", "a"), (2, "v", "b")], "query long, variant string, reference_digest string")
    assert {tuple(r) for r in matching.robustness(changed, hits).collect()} == {("u", 2, 1), ("v", 1, 0)}


@pytest.mark.parametrize("family", ["logistic", "boosted"])
def test_disabled_features(spark, family):
    df = spark.range(200).select((F.col("id") % 2).cast("double").alias("label"), F.lit(1.0).alias("weight"), (F.col("id") % 2 + F.col("id") % 7 / 10.0).alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    held = models.fit(models.masked(df, ["b"]), ["a", "b"], family)
    models.assert_unused(held, ["a", "b"], ["b"])
    with pytest.raises(ValueError, match="are used: a"):
        models.assert_unused(held, ["a", "b"], ["a"])
    with pytest.raises(ValueError, match="no features: c"):
        models.assert_unused(held, ["a", "b"], ["c"])
