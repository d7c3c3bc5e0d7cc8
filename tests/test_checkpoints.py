"""Checkpoints go once no frame refers to them, where the session asks for it."""

import gc
import time

from pyspark.sql import functions as F

from emberline.operators.graph import checkpointed, shared_folder


def test_checkpoints_go(spark):
    from pathlib import Path
    from urllib.parse import urlsplit

    shared_folder(spark)
    folder = Path(urlsplit(spark.sparkContext.getCheckpointDir()).path)
    before = set(folder.glob("rdd-*"))
    held = checkpointed(spark.range(100).withColumn("x", F.col("id") * 2))
    later = held.where("x > 100")
    own = set(folder.glob("rdd-*")) - before
    assert own
    del held
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(1)
    assert later.count() == 49 and all(p.exists() for p in own)
    del later
    for _ in range(40):
        gc.collect()
        spark._jvm.System.gc()
        if not any(p.exists() for p in own):
            return
        time.sleep(0.5)
    raise AssertionError("checkpoints stay")
