"""Stateful streams: a clip's blocks filtered in order, whatever order they arrive in, and sessions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberline.operators.frames import FLOOR, OFFSET
from emberline.operators.signal import HIGH_PASS_HZ, RATE, SHELF_DB, SHELF_HZ, filter_section, high_pass, high_shelf

LEVELS = "clip string, block long, level double, waiting boolean"
#: The next block, both sections' states, and the blocks that came before their turn.
STATE = "next long, z array<double>, blocks array<long>, samples array<array<double>>"


def block_level(samples: np.ndarray, z: np.ndarray) -> tuple[float, np.ndarray]:
    """The weighted level of one block, and the sections' states after it; ``z`` has four numbers."""
    x, states = samples[None, :].astype(float), z.reshape(2, 2, 1)
    after = []
    for section, state in zip((high_pass(HIGH_PASS_HZ, RATE), high_shelf(SHELF_HZ, SHELF_DB, RATE)), states, strict=True):
        x, own = filter_section(x, section, state)
        after.append(own)
    power = float((x * x).mean()) if x.size else 0.0
    return max(FLOOR, OFFSET + 10 * float(np.log10(max(power, 1e-9)))), np.concatenate(after).ravel()


def ordered_levels(stream: DataFrame, patience_ms: int | None = None) -> DataFrame:
    """``clip, block, level, waiting`` of a stream of ``clip string, block long, samples
    array<double>``; blocks count from 0 for each clip.

    The filter's state goes on from block to block, so a block waits in the state
    until all before it have come; one that comes again is passed over.  With
    ``patience_ms``, a clip that waits longer gives a row that names the block it
    needs, with ``waiting``, so that it can be put into the queue anew; it goes
    on waiting, and its blocks are whole when they come.  Such a stream runs
    until it is stopped; one without ends with what has landed, if so triggered.
    """

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, z, blocks, samples = state.get if state.exists else (0, [0.0] * 4, [], [])
        held = dict(zip(blocks, samples, strict=True))
        if state.hasTimedOut:
            state.setTimeoutDuration(patience_ms)
            yield pd.DataFrame({"clip": [key[0]], "block": [turn], "level": [None], "waiting": [True]}).astype({"level": float})
            return
        for batch in batches:
            for block, x in zip(batch["block"], batch["samples"], strict=True):
                if block >= turn:
                    held.setdefault(int(block), [float(v) for v in (x if x is not None else [])])
        rows = []
        z = np.array(z)
        while turn in held:
            level, z = block_level(np.array(held.pop(turn)), z)
            rows.append((key[0], turn, level, False))
            turn += 1
        state.update((turn, z.tolist(), list(held), list(held.values())))
        if held and patience_ms is not None:
            state.setTimeoutDuration(patience_ms)
        if rows:
            yield pd.DataFrame(rows, columns=["clip", "block", "level", "waiting"])

    return stream.groupBy("clip").applyInPandasWithState(work, LEVELS, STATE, "append", GroupStateTimeout.NoTimeout if patience_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def sessions(stream: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``key, start, end, events`` of each session: events less than ``gap`` apart, merged
    whatever order they come in.  A session is given once the watermark has passed
    its end; an event later than ``late`` is dropped and counted by the query's progress."""
    timed = stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    out = timed.groupBy(F.col(key), F.session_window("_at", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def dropped_late(query) -> int:
    """Rows that a finished query has dropped as too late, over all its batches that are known."""
    return sum(int(o["numRowsDroppedByWatermark"]) for p in query.recentProgress for o in p["stateOperators"])
