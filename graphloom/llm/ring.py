"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (operator 4)."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions of the virtual nodes, and the shard of each."""
    nodes = sorted((int.from_bytes(hashlib.blake2b(f"{s}:{v}".encode(), digest_size=8).digest(), "big", signed=True), s) for s in range(shards) for v in range(vnodes))
    return np.array([p for p, _ in nodes], dtype=np.int64), np.array([s for _, s in nodes])


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Most rows of each shard: with no slack they sum to all rows and differ by one at most."""
    if slack <= 0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [int(-(-rows * (1 + slack) // shards))] * shards


def segments(counts: dict[int, int], owner: np.ndarray, room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): how the keys of each arc fill shards.

    Arcs are served in ring order and the keys of one by position. A full shard passes them on to the shard
    of the next virtual node clockwise. There are at most arcs + shards segments for each lap, whatever the rows.
    """
    room, used, out, n = list(room), Counter(), [], len(owner)
    for arc in sorted(counts):
        left, rank = counts[arc], 0
        for step in range(n):
            if not left:
                break
            shard = int(owner[(arc + step) % n])
            if take := min(left, room[shard]):
                out.append((arc, rank, rank + take, shard, used[shard]))
                used[shard] += take
                room[shard] -= take
                rank += take
                left -= take
        if left:
            raise ValueError("the shards' capacities are below the rows")
    return out


def shard(df: DataFrame, key: Column, shards: int, vnodes: int = 64, slack: float = 0.0, part_rows: int | None = None) -> DataFrame:
    """Adds shard and slot (gapless from 0 in each shard), and home_shard, which the ring names before any overflow.

    A row's place on the ring is a hash of its key alone. Each shard holds at most its capacity: an equal share
    (differing by one row at most) with slack 0, else (1 + slack) times that share. What overflows continues clockwise.
    Rows of an arc are ranked in parts of some `part_rows` (500, or a 200,000th of all rows), dealt by a hash of all columns, so that neither a hot arc nor
    a repeated key is one task's; rows equal in all columns share a part. What reaches the driver are the row counts of
    the shards * vnodes arcs and of their parts, one more for each `part_rows` rows.

    Null keys share one place; rows of one key keep together until their shard is full, in arbitrary order among
    identical rows. An empty table gives an empty result. Columns of df stay, whatever their names, but for those three.
    """
    positions, owner = ring(shards, vnodes)
    width = len(positions)
    kept = [c for c in df.columns if c not in ("shard", "slot", "home_shard")]
    told = [F.col(f"`{c}`") for c, kind in df.dtypes if kind.split("<")[0] not in ("map", "variant")]

    @F.pandas_udf("int")
    def arc_of(at):
        import pandas as pd

        return pd.Series((np.searchsorted(positions, at.to_numpy(), side="left") % width).astype("int32"))

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(0)).alias("row"), F.xxhash64(key).alias("at"), F.hash(*told).alias("tie")).withColumn("arc", arc_of("at"))
    arcs = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = df.sparkSession
    part_rows = part_rows or max(500, sum(arcs.values()) // 200_000)
    if max(arcs.values(), default=0) > part_rows:
        # one row an arc
        deal = spark.createDataFrame([(a, 1 + n // part_rows) for a, n in arcs.items()], "arc int, parts int")
        rows = rows.join(F.broadcast(deal), "arc").withColumn("part", F.pmod(F.xxhash64("at", "tie"), F.col("parts")).cast("int"))
        counted = {(r["arc"], r["part"]): r["n"] for r in rows.groupBy("arc", "part").agg(F.count(F.lit(1)).alias("n")).collect()}
    else:
        rows = rows.withColumn("part", F.lit(0))
        counted = {(a, 0): n for a, n in arcs.items()}
    first, upto = {}, Counter()
    for arc, part in sorted(counted):
        first[arc, part] = upto[arc]
        upto[arc] += counted[arc, part]
    by_arc: dict[int, list] = {}
    for arc, lo, hi, s, slot in segments(arcs, owner, capacities(sum(arcs.values()), shards, slack)):
        by_arc.setdefault(arc, []).append((lo, hi, s, slot))
    plan = []
    for (arc, part), base in first.items():
        end = base + counted[arc, part]
        plan += [(arc, part, max(lo, base) - base, min(hi, end) - base, s, slot + max(lo, base) - lo, int(owner[arc])) for lo, hi, s, slot in by_arc[arc] if lo < end and hi > base]
    # at most one row for each arc, part and segment: a bound that the ring and part_rows set
    plan = spark.createDataFrame(plan, "arc int, part int, lo long, hi long, shard int, slot long, home_shard int")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("arc", "part").orderBy("at", "tie")) - 1)
    joined = ranked.join(F.broadcast(plan), ["arc", "part"]).where("rank >= lo AND rank < hi")
    return joined.select(*[F.col("row").getField(c).alias(c) for c in kept], "shard", (F.col("slot") + F.col("rank") - F.col("lo")).alias("slot"), "home_shard")
