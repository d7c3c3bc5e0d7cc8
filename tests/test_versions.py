"""Model versions that only go live when they score as before, and matrices that tell when they were changed."""

import glob
import shutil

import pytest
from pyspark.sql import functions as F

from emberline.sources.versions import Matrix, ModelStore


def score(model, rows):
    return rows.select("id", (F.col("x") * float(model["weight"]) + float(model["intercept"])).alias("score"))


def test_model_store(spark, tmp_path):
    store = ModelStore(spark, str(tmp_path / "models"))
    probe = spark.createDataFrame([(k, k / 7) for k in range(20)], "id long, x double")
    with pytest.raises(FileNotFoundError):
        store.load()
    first = {"weight": 0.1 + 0.2, "intercept": -1 / 3}
    one = store.save(first, score, probe, "id")
    assert store.load() == first
    two = store.save({"weight": 2.0, "intercept": 0.0}, score, probe, "id")
    assert store.load()["weight"] == 2.0 and store.load(one) == first and one != two

    def other(model, rows):
        # a model that reads back differently: the first call is the one in memory
        calls.append(1)
        return score(model, rows).withColumn("score", F.col("score") + (len(calls) - 1) * 1e-6)

    for bad in (other, lambda m, rows: score(m, rows).withColumn("score", F.lit(float("nan"))), lambda m, rows: score(m, rows).limit(0)):
        calls = []
        with pytest.raises(ValueError, match="scores differ"):
            store.save(first, bad, probe, "id")
        assert store.load()["weight"] == 2.0


def test_matrix(spark, tmp_path):
    path = str(tmp_path / "matrix")
    m = Matrix(spark, path, "id", ["a", "b"])
    rows = lambda ks: spark.createDataFrame([(k, k * 0.5, -k) for k in ks], "id long, a double, b int")
    assert m.write("x", rows([3, 1, 2]).repartition(3)) and m.write("y", rows(range(10, 60)).repartition(4)) and not m.write("x", rows([9]))
    got = m.read().where("shard = 'x'").orderBy("place").collect()
    assert [(r.place, r.id, r.a, r.b) for r in got] == [(0, 1, 0.5, -1.0), (1, 2, 1.0, -2.0), (2, 3, 1.5, -3.0)] and m.read().count() == 53
    for bad, why in ((spark.createDataFrame([(1, float("nan"), 1)], "id long, a double, b int"), "finite"), (spark.createDataFrame([(1, None, 1)], "id long, a double, b int"), "finite"), (rows([1, 1]), "repeats")):
        with pytest.raises(ValueError, match=why):
            m.write("z", bad)
    # what these left behind is not read, and the shard can be written anew
    assert m.read().count() == 53 and m.write("z", rows([7])) and m.read().count() == 54
    with pytest.raises(ValueError, match="other columns"):
        Matrix(spark, path, "id", ["b", "a"]).read()
    # one value changed, two rows in each other's place, a row lost
    keep = spark.read.parquet(f"{path}/rows/shard=x").collect()
    for changed in ([(1, 0.5, -1.0, 0), (2, 1.0, -2.5, 1), (3, 1.5, -3.0, 2)], [(1, 0.5, -1.0, 1), (2, 1.0, -2.0, 0), (3, 1.5, -3.0, 2)], [(1, 0.5, -1.0, 0), (2, 1.0, -2.0, 1)]):
        shutil.rmtree(f"{path}/rows/shard=x")
        spark.createDataFrame(changed, "id long, a double, b double, place long").write.parquet(f"{path}/rows/shard=x")
        with pytest.raises(ValueError, match=r"\['x'\]"):
            m.read()
    assert len(keep) == 3 and glob.glob(f"{path}/manifest/*.parquet")
