"""Distinct users in trailing windows of any length, by persistent segment trees.

Users of one kind are dealt into shards, and time into blocks that also see the
longest window before them, so that no user, kind or day has to fit one task.
A shard's tree has one version a minute, in which each user marks the minute of
its latest click: the distinct users of the window of ``L`` minutes are the
marks of the last ``L`` positions, whatever ``L`` is.  A second tree marks each
user's ``h``-th latest click, whose marks in the window are the users with
``h`` clicks or more.  Shards give the minutes at which their counts change, by
how much; these changes are added up and summed along each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces
from .persistent import PersistentForest

#: Minutes of a block, rows that a shard of a block should hold, and shards of each at least.
BLOCK, SHARD_ROWS, LEAST_SHARDS = 5760, 20_000, 16
#: Rows whose trees are built together.
TOGETHER = 100_000


def minute_of(df: DataFrame, ts: str) -> F.Column:
    """Minutes since 1970 of a time stamp, floored; one without a zone is read as UTC."""
    at = F.col(f"`{ts}`")
    if df.schema[ts].dataType.simpleString() == "timestamp_ntz":
        return (F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 1440 + F.hour(at) * 60 + F.minute(at)).cast("long")
    return F.expr(f"unix_micros(`{ts}`) div 60000000 - if(unix_micros(`{ts}`) % 60000000 < 0, 1, 0)").cast("long")


def changes(group: np.ndarray, user: np.ndarray, minute: np.ndarray, clicks: np.ndarray, lengths: list[int], hot: tuple[int, int], first: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups, minutes and changes of all counts at these minutes.

    Rows are sorted by group, user (-1: none) and minute, counted from 0;
    counts are those of minutes ``first`` to ``end - 1``.
    """
    bits = int(end).bit_length()
    groups, span = int(group[-1]) + 1, 1 << bits
    least, longest = hot
    ask = [group * span + np.maximum(minute, first)]
    known = user >= 0
    g, u, t, n = group[known], user[known], minute[known], clicks[known]
    same = np.r_[False, (g[1:] == g[:-1]) & (u[1:] == u[:-1])] if len(g) else np.zeros(0, bool)
    ask += [g * span + np.minimum(t + length, span - 1) for length in lengths]
    # latest click: the mark moves from the row before to this one
    moved = np.flatnonzero(same)
    latest = PersistentForest(groups, bits, np.r_[g, g[moved]], np.r_[t, t[moved]], np.r_[t, t[moved - 1]], np.r_[np.ones(len(g), np.int64), np.full(len(moved), -1, np.int64)], span)
    # h-th latest: the row in which the click that has h - 1 later ones lies
    ends = np.cumsum(n)
    heads = np.maximum.accumulate(np.where(same, 0, np.arange(len(g)))) if len(g) else np.zeros(0, np.int64)
    before = ends[heads] - n[heads] if len(g) else ends
    reached = ends - before >= least
    row = np.searchsorted(ends, ends - least + 1)
    marked = np.flatnonzero(reached)
    again = np.flatnonzero(reached & same & np.r_[False, reached[:-1]]) if len(g) else marked
    hth = PersistentForest(
        groups, bits, np.r_[g[marked], g[again]], np.r_[t[marked], t[again]], np.r_[t[row[marked]], t[row[again - 1]]],
        np.r_[np.ones(len(marked), np.int64), np.full(len(again), -1, np.int64)], span,
    )
    ask.append(g[marked] * span + np.minimum(t[row[marked]] + longest, span - 1))
    key = np.unique(np.concatenate(ask))
    key = key[(key % span >= first) & (key % span < end)]
    at_group, at = key // span, key % span
    counts = [latest.suffix(at_group, at, np.maximum(at - length + 1, 0)) for length in lengths]
    counts.append(hth.suffix(at_group, at, np.maximum(at - longest + 1, 0)))
    values = np.stack(counts, axis=1) if len(key) else np.zeros((0, len(lengths) + 1), np.int64)
    fresh = np.r_[True, at_group[1:] != at_group[:-1]] if len(key) else np.zeros(0, bool)
    steps = values.copy()
    steps[1:] -= np.where(fresh[1:, None], 0, values[:-1])
    return at_group, at, steps


def rolling_users(
    df: DataFrame, windows: dict[str, int], hot: tuple[str, int, int], ident: str = "click_id", ts: str = "ts", user: str = "client_id", kind: str = "kind",
    block: int = BLOCK, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``kind, minute`` of every minute with a click of the kind, with the distinct
    users of each window (name and minutes), and those of ``hot``: name, clicks at
    least, minutes.

    Rows of equal ``ident`` are one click: where such rows differ, the first by
    minute, kind and user counts; rows without ``ident`` are clicks of their
    own.  Rows without time or kind take no part; clicks without a user give
    their minute a row but count for nobody.  Other columns are not read; an
    empty table gives an empty result.
    """
    lengths, (hot_name, least, hot_length) = list(windows.values()), hot
    reach = max([hot_length, *lengths]) - 1
    spark = df.sparkSession
    rows = df.select(F.col(f"`{ident}`").alias("i"), F.col(f"`{kind}`").alias("k"), minute_of(df, ts).alias("m"), F.col(f"`{user}`").alias("u")).where("m IS NOT NULL AND k IS NOT NULL")
    # how finely users are dealt follows the fullest block of one kind
    most = rows.groupBy("k", F.expr(f"m div {block}")).count().agg(F.max("count")).first()[0] or 0
    shards = pieces(most, shard_rows, LEAST_SHARDS)
    once = rows.groupBy("i", F.when(F.col("i").isNull(), F.monotonically_increasing_id()).alias("j")).agg(F.min(F.struct("m", "k", F.col("u").isNull().alias("n"), "u")).alias("c")).select("c.*")
    summed = once.groupBy("k", "u", "m").agg(F.count("*").alias("n"))
    b = f"floor(m / {block})"
    seen = summed.withColumn("b", F.explode(F.expr(f"sequence({b}, floor((m + {reach}) / {block}))"))).withColumn("s", F.pmod(F.xxhash64("u"), F.lit(shards)))
    dealt = seen.select("k", "b", "s", "u", (F.col("m") - F.col("b") * block + reach).alias("t"), "n").repartition("k", "b", "s").sortWithinPartitions("k", "b", "s", "u", "t")
    first, end = reach, reach + block
    names = [*windows, hot_name]

    def done(table: pa.Table) -> pa.RecordBatch:
        def codes(column: str) -> np.ndarray:
            return pa.compute.fill_null(table.column(column).combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)

        k, blocks, s, u, t, n = codes("k"), *(table.column(c).to_numpy() for c in "bs"), codes("u"), *(table.column(c).to_numpy().astype(np.int64) for c in "tn")
        new_pair = np.r_[True, (k[1:] != k[:-1]) | (blocks[1:] != blocks[:-1])]
        group, pair = np.cumsum(new_pair | np.r_[True, s[1:] != s[:-1]]) - 1, np.cumsum(new_pair) - 1
        at_group, at, steps = changes(group, u, t, n, lengths, (least, hot_length), first, end)
        pair_of = np.empty(int(group[-1]) + 1, np.int64)
        pair_of[group] = pair
        # shards of one kind and block that lie here are added up
        own = t >= first
        key = np.concatenate([pair_of[at_group] * (end + 1) + at, pair[own] * (end + 1) + t[own]])
        value = np.zeros((len(key), steps.shape[1] + 1), np.int64)
        value[: len(at), :-1], value[len(at) :, -1] = steps, 1
        distinct, place = np.unique(key, return_inverse=True)
        total = np.zeros((len(distinct), value.shape[1]), np.int64)
        np.add.at(total, place, value)
        distinct, total = distinct[some := total.any(axis=1)], total[some]
        head = np.flatnonzero(new_pair)[distinct // (end + 1)]
        minute = blocks[head] * block + distinct % (end + 1) - reach
        return pa.RecordBatch.from_arrays(
            [table.column("k").combine_chunks().take(pa.array(head)), pa.array(blocks[head]), pa.array(minute), *(pa.array(total[:, c]) for c in range(total.shape[1]))],
            ["k", "b", "m", *(f"d{c}" for c in range(len(names))), "own"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows_held = [], 0
        for batch in batches:
            held, rows_held = [*held, batch], rows_held + batch.num_rows
            if rows_held >= TOGETHER:
                table = pa.Table.from_batches(held)
                last = np.ones(table.num_rows, bool)
                for c in "kbs":
                    last &= pa.compute.equal(table.column(c), table.column(c)[-1]).to_numpy()
                cut = int(np.argmax(last))  # the last shard may go on in the next batch
                if cut:
                    yield done(table.slice(0, cut))
                held, rows_held = table.slice(cut).to_batches(), table.num_rows - cut
        if rows_held:
            yield done(pa.Table.from_batches(held))

    deltas = ", ".join(f"d{c} long" for c in range(len(names)))
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    stepped = dealt.mapInArrow(run, f"k {kinds['k']}, b long, m long, {deltas}, own long")
    added = stepped.groupBy("k", "b", "m").agg(*(F.sum(f"d{c}").alias(f"d{c}") for c in range(len(names))), F.sum("own").alias("own"))
    along = Window.partitionBy("k", "b").orderBy("m").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed_up = added.select("k", "m", "own", *(F.sum(f"d{c}").over(along).alias(f"d{c}") for c in range(len(names))))
    return summed_up.where("own > 0").select(F.col("k").alias("kind"), F.col("m").alias("minute"), *(F.col(f"d{c}").alias(n) for c, n in enumerate(names)))


ROLLING_SQL = """WITH c AS (SELECT click_id, min(struct_pack(m := floor(epoch_us(ts) / 60000000)::BIGINT, k := kind, n := client_id IS NULL, u := client_id)) AS c
    FROM clicks WHERE ts IS NOT NULL AND kind IS NOT NULL AND click_id IS NOT NULL GROUP BY click_id
    UNION ALL SELECT NULL, struct_pack(m := floor(epoch_us(ts) / 60000000)::BIGINT, k := kind, n := client_id IS NULL, u := client_id) FROM clicks WHERE ts IS NOT NULL AND kind IS NOT NULL AND click_id IS NULL),
  e AS (SELECT c.k AS kind, c.u AS u, c.m AS minute, count(*) AS n FROM c GROUP BY ALL),
  m AS (SELECT DISTINCT kind, minute FROM e),
  w AS (SELECT m.kind, m.minute, e.u, sum(n) AS n, max(e.minute) AS latest FROM m JOIN e ON m.kind = e.kind AND e.minute BETWEEN m.minute - 719 AND m.minute GROUP BY ALL)
  SELECT kind, minute, count(u) FILTER (WHERE latest > minute - 10)::BIGINT AS users_short, count(u) FILTER (WHERE latest > minute - 60)::BIGINT AS users_middle,
    count(u)::BIGINT AS users_long, count(u) FILTER (WHERE n >= 5)::BIGINT AS hot_users FROM w GROUP BY ALL"""
