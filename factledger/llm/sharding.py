"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a 64-bit ring and a row belongs to the first point clockwise of
its key's hash. A shard takes no more than ``load_factor`` times the mean load; what doesn't fit
continues clockwise to the next shard with room. With the default ``load_factor`` of 1 all shards end near the mean.

What is placed are units: the keys between two ring points, in ``PARTS`` parts by their hash. So rows of one key stay together.
Only a key that weighs more than a ``HEAVY``-th of a shard is dealt to units of its own, of about that weight; they go to
the key's own shard while it has room and on clockwise, so a key that no shard can hold is divided, and no other. The ring is
resolved on the units' sums: ``shards * vnodes * PARTS`` numbers and ``shards * HEAVY`` for heavy keys at most, whatever the
input's size; nothing is sorted by more than a unit.

Defined results: null keys hash alike; null and empty texts count only the fixed overhead; a row that fits nowhere goes to the
emptiest shard; repeated rows are placed one by one; within a unit slots follow the load, the hash and then all named columns; an
empty table gives an empty result; only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

PARTS, HEAVY = 8, 200


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Ring points in ascending order, and the shard that owns each."""
    points = sorted(
        (int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:8], "big", signed=True), s)
        for s in range(shards)
        for v in range(vnodes)
    )
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int64)


def resolve(units: list[tuple[int, int, int]], owners: np.ndarray, shards: int, load_factor: float) -> dict[int, int]:
    """The shard of each unit. Units are (unit, arc, load) in the order in which they are placed."""
    total = sum(load for _, _, load in units)
    room = [total * load_factor / shards] * shards
    placed = {}
    for unit, arc, load in units:
        shard, passed = None, set()
        for step in range(len(owners)):  # clockwise from the unit's own point
            s = int(owners[(arc + step) % len(owners)])
            if s in passed:
                continue
            if room[s] >= load:
                shard = s
                break
            passed.add(s)
            if len(passed) == shards:
                break
        if shard is None:
            shard = max(range(shards), key=lambda s: (room[s], -s))
        room[shard] -= load
        placed[unit] = shard
    return placed


def shard_rows(rows: DataFrame, key: Column, load: Column, shards: int = 40, vnodes: int = 128, load_factor: float = 1.0) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, a gapless number from 0 within the shard.

    ``key`` decides the place on the ring, ``load`` (a positive integer) what the row weighs.
    """
    spark = rows.sparkSession
    points, owners = ring(shards, vnodes)

    @F.pandas_udf("int")
    def arc_of(position: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(points, position.to_numpy()) % len(points)).astype(np.int32))

    named = rows.columns
    # written, so the number that deals a heavy key's rows is drawn once
    keyed = cut(
        rows.withColumn("_position", F.xxhash64(F.lit(17), key)).withColumn("_load", load.cast("long"))
        .withColumns({"_arc": arc_of("_position"), "_at": F.monotonically_increasing_id()}),
        "ring-keys",
    )
    total = keyed.agg(F.sum("_load")).first()[0] or 0
    weights = keyed.groupBy("_position", "_arc").agg(F.sum("_load").alias("w"), F.count("*").alias("n"))
    heavy = weights.where((F.col("w") * shards * HEAVY > total) & (F.col("n") > 1)).collect()  # under shards * HEAVY
    units, order, dealt = [], {}, []
    free = len(points) * PARTS
    for r in sorted(heavy, key=lambda r: (-r["w"], r["_position"])):
        parts = -(-r["w"] * shards * HEAVY // total)
        dealt.append((r["_position"], free, parts))
        order.update({free + k: (0, len(dealt), r["_arc"]) for k in range(parts)})
        free += parts
    cells = F.col("_arc") * PARTS + F.pmod("_position", F.lit(PARTS)).cast("int")
    marked = keyed.join(F.broadcast(spark.createDataFrame(dealt, "_position long, _first int, _parts int")), "_position", "left")
    marked = marked.withColumn("_unit", F.coalesce(F.col("_first") + F.pmod("_at", F.col("_parts")).cast("int"), cells)).drop("_first", "_parts", "_at")
    sums = marked.groupBy("_unit").agg(F.sum("_load").alias("w"), F.count("*").alias("n")).collect()
    for r in sums:
        rank, group, arc = order.get(r["_unit"], (1, 0, r["_unit"] // PARTS))
        units.append((rank, group, -r["w"], r["_unit"], arc))
    owner = resolve([(unit, arc, -minus) for _, _, minus, unit, arc in sorted(units)], owners, shards, load_factor)
    base, slots = defaultdict(int), []
    for r in sorted(sums, key=lambda r: r["_unit"]):
        shard = owner[r["_unit"]]
        slots.append((r["_unit"], shard, base[shard]))
        base[shard] += r["n"]
    starts = spark.createDataFrame(slots, "_unit int, shard int, _base long")
    within = Window.partitionBy("_unit").orderBy(F.desc("_load"), "_position", *named)
    ranked = marked.withColumn("_rank", F.row_number().over(within) - 1)
    return ranked.join(F.broadcast(starts), "_unit").select(*named, "shard", (F.col("_base") + F.col("_rank")).alias("slot"))  # bounded: a row for each unit
