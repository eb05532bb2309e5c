"""Mixing sources to target weights by systematic sampling.

Targets: sources in code-point order (null last) weigh ``weights`` in turn and share ``budget`` times
all sizes; a target stops at ``most`` times its source's size and the excess is shared again by weight.
That fixed point is a water level: in order of ``most * size / weight`` the first sources are full and
the others get ``level * weight``.

Sampling: every document of a source expects ``target / size of source`` copies. With the documents in
order of size the running sum of expected copies is shifted by one random offset a source, and a copy is
emitted for each integer boundary that a document's step crosses. No document gets more than ``most``
copies, and ordering by size keeps what is taken near the target.

Ranks come from a range partitioning by (source, size, doc_id): any source, however large, is spread over
partitions, and only one offset for each (partition, source) is summed up.

Defined results: null texts have size 0; a null source is a source of its own; null doc_ids sort first;
repeated rows are documents of their own; ties go by the text's hash; a very long text weighs as many words as it has and may be
taken or left whole; columns of any other name are carried along and cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target from (source, source_size), one row a source."""
    every = Window.partitionBy()
    ranked = sizes.withColumn("_turn", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("_turn") % len(weights) + 1)
    filled = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * most)
    by_level = every.orderBy(F.col("_cap") / F.col("_w"), "_turn")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.sum("source_size").over(every) * F.lit(float(budget)) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    ) / F.sum("_w").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    levelled = filled.withColumn("_level", level).withColumn("_full", F.col("_cap") <= F.col("_level") * F.col("_w"))
    water = F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_w"), "_turn", "_level"))).over(every)["_level"]
    return levelled.select(
        "source", "source_size", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(water * F.col("_w")).alias("target")
    )


def offset(source: Column, seed: int) -> Column:
    """One uniform number in [0, 1) for each source."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: int = 2, seed: int = 5) -> DataFrame:
    """doc_id, source, size, mark, source_size, target, copies for each row of ``docs`` (doc_id, source, text).

    ``mark`` is a hash of the text; it orders rows that are equal in source, size and doc_id.
    """
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark")), "mix-sizes")
    aims = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, most)
    order = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("doc_id").asc(), F.col("mark").asc()]
    # the id holds the partition above bit 33 and the row's number in it below
    placed = cut(sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "mix-order")
    part = F.shiftright("_at", 33).alias("_part")
    counts = placed.groupBy("source", part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first"))
        .join(aims.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .select(F.col("source").alias("_source"), "_part", "_before", "source_size", "target")
    )
    ranked = placed.withColumn("_part", part).join(
        starts.withColumnRenamed("_part", "_p"), (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_source"))
    )
    rank = F.col("_at") + F.col("_before") + 1
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor(rank * rate + offset(F.col("source"), seed)) - F.floor((rank - 1) * rate + offset(F.col("source"), seed))
    return ranked.select("doc_id", "source", "size", "mark", "source_size", "target", crossed.cast("long").alias("copies"))


def emit(docs: DataFrame, **settings) -> DataFrame:
    """``docs``, all columns, with each row as often as the mix takes it.

    Rows are known by doc_id, source and a hash of the text; those equal in all three are told apart by their number.
    """
    taken = mix(docs, **settings).select(F.xxhash64("doc_id", "source", "mark").alias("other"), "copies")
    numbered = taken.select("other", "copies", F.row_number().over(Window.partitionBy("other").orderBy("copies")).alias("nth"))
    key = F.xxhash64("doc_id", "source", F.xxhash64("text"))
    rows = docs.select(key.alias("key"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))  # a struct, so that no name can clash
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("key")))
    # the difference keeps the number out of the join's keys, so the window's partitioning serves the join too
    joined = rows.join(numbered, (F.col("key") == F.col("other")) & (F.col("n") - F.col("nth") == 0)).where("copies > 0")
    return joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
