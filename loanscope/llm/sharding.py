"""Operator 1: sharding on a consistent-hash ring with bounded loads.

Every shard owns ``vnodes`` points of a hash ring; a row hashes (by its key) to
a point of the ring and belongs to the shard that owns the arc.  A shard takes
its own rows, in ring order, up to its capacity; rows beyond it walk clockwise
to the next shard that still has room.  With ``load=1`` the capacities are
``n // shards`` or one more, so row counts differ by at most one (law ``rows``);
with ``load > 1`` every shard holds at most ``ceil(load * n / shards)`` rows and
fewer rows move when the number of shards changes.

At scale: rows are cut down to (key, hash, payload) and written once; the ring is
divided into ``shards * vnodes * SUBCELLS`` cells, a number that does not depend
on the data.  Only the row count of each cell reaches the driver, which walks the
ring over counts and returns, per cell, runs ``(first rank, last rank) -> shard,
first slot``.  Ranks are row numbers inside one cell; the cell also takes the
row's place in the written table into account, so a key that a third of all rows
share is spread over all subcells of its arc and no task gets it whole.

Null keys hash like any value; null and empty texts have size 8 and crc32 0;
repeated rows are separate rows with slots of their own; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table

#: Cells per arc.
SUBCELLS = 64
RING = 1 << 62


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """Sorted (point, shard); a point closes the arc that ends at it."""
    points = {xxhash.xxh64_intdigest(f"shard|{s}|{v}", seed=7) % RING: s
              for s in range(shards) for v in range(vnodes)}
    return sorted(points.items())


def capacities(n: int, shards: int, load: float) -> list[int]:
    if load <= 1:
        return [n // shards + (s < n % shards) for s in range(shards)]
    return [int(-(-load * n // shards))] * shards


def walk(counts: dict[tuple[int, int], int], owners: list[int], caps: list[int]) -> list[tuple]:
    """Place cell counts on the ring.  ``counts``: rows by (arc, subcell);
    ``owners``: shard of each arc, clockwise.  Returns runs
    (arc, subcell, first rank, rows, shard, first slot)."""
    room, slot, runs, over = list(caps), [0] * len(caps), [], [deque() for _ in owners]

    def take(cell, first, rows, s):
        n = min(rows, room[s])
        if n:
            runs.append((*cell, first, n, s, slot[s]))
            room[s] -= n
            slot[s] += n
        return first + n, rows - n

    for cell in sorted(counts):  # each shard's own rows first, in ring order
        first, rest = take(cell, 0, counts[cell], owners[cell[0]])
        if rest:
            over[cell[0]].append((cell, first, rest))
    moving, arc, idle = deque(), 0, 0
    while moving or any(over):  # the rest walks clockwise from arc to arc
        while moving and room[owners[arc]]:
            cell, first, rows = moving.popleft()
            first, rest = take(cell, first, rows, owners[arc])
            if rest:
                moving.appendleft((cell, first, rest))
        moving.extend(over[arc])
        over[arc].clear()
        arc = (arc + 1) % len(owners)
        idle += 1
        if idle > 3 * len(owners):
            raise ValueError("capacities are smaller than the number of rows")
    return runs


def assign(df: DataFrame, key: str, shards: int, vnodes: int = 64, load: float = 1.0,
           payload: dict | None = None) -> DataFrame:
    """``key``, the ``payload`` columns (name -> expression), ``shard`` and a
    gapless ``slot`` inside the shard, one row for each row of ``df``."""
    spark = df.sparkSession
    payload = payload or {}
    points = ring(shards, vnodes)
    bounds = np.array([p for p, _ in points], np.int64)
    owners = [s for _, s in points]
    rows = staged(df.select(F.col(key).alias("_key"), F.pmod(F.xxhash64(F.lit(11), F.col(key)), F.lit(RING)).alias("_at"),
                            *[e.alias(f"_p{i}") for i, e in enumerate(payload.values())], F.monotonically_increasing_id().alias("_row")), "shard-rows")

    @F.pandas_udf("int")
    def arc_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, at.to_numpy()) % len(bounds)).astype("int32")

    # A row's number is written with it: later jobs may read the table in other splits.
    placed = (rows.withColumn("_arc", arc_of("_at"))
                  .withColumn("_sub", F.pmod(F.xxhash64("_row"), F.lit(SUBCELLS)).cast("int")))
    # At most shards * vnodes * SUBCELLS counts, whatever the table's size.
    counts = {(r[0], r[1]): r[2] for r in placed.groupBy("_arc", "_sub").count().collect()}
    runs = walk(counts, owners, capacities(sum(counts.values()), shards, load))
    plan = spark.createDataFrame(runs or [(-1, -1, 0, 0, 0, 0)],
                                 "_arc int, _sub int, _first long, _n long, shard int, _slot long")
    rank = F.row_number().over(Window.partitionBy("_arc", "_sub").orderBy("_row")) - 1
    return (placed.withColumn("_rank", rank.cast("long"))
                  .join(F.broadcast(plan), ["_arc", "_sub"])  # bounded like the counts
                  .where((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_n")))
                  .select(F.col("_key").alias(key), *[F.col(f"_p{i}").alias(c) for i, c in enumerate(payload)],
                          "shard", (F.col("_slot") + F.col("_rank") - F.col("_first")).alias("slot")))


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents into 24 shards whose row counts are at most one apart."""
    text = F.coalesce("text", F.lit(""))
    out = assign(table(spark, sf_dir, "documents"), "doc_id", 24, payload={
        "size": F.octet_length(text).cast("long") + 8, "text_crc32": F.crc32(text.cast("binary"))})
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
