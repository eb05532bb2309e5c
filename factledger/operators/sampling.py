"""Samples by the smallest hashes: the same rows however they are partitioned, from partial top k's and no global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))))


def smallest(rows: DataFrame, key: str, n: int, seed: str = "", per: str | None = None) -> DataFrame:
    """``n`` rows at most, those with the smallest hash of ``key`` (then by key); with ``per`` of each group. Each task keeps ``n`` of what it has, and these are merged."""
    drawn = rows.withColumn("_draw", draw(F.col(key), seed))
    if per is None:
        return drawn.orderBy("_draw", key).limit(n).drop("_draw")
    return drawn.withColumn("_n", F.row_number().over(Window.partitionBy(per).orderBy("_draw", key))).where(F.col("_n") <= n).drop("_draw", "_n")


def pool(rows: DataFrame, key: str, size: Column, enough: int, seed: str = "") -> DataFrame:
    """Rows in order of their hash until their sizes come to ``enough``; the one that reaches it is the last.

    Sizes under one, and null ones, count nothing and stay out, so ``enough`` rows are always enough: no more are drawn, and only these are summed up.
    """
    drawn = rows.withColumns({"_size": size.cast("long"), "_draw": draw(F.col(key), seed)}).where("_size >= 1").orderBy("_draw", key).limit(enough)
    before = Window.partitionBy().orderBy("_draw", key).rowsBetween(Window.unboundedPreceding, -1)  # over ``enough`` rows at most
    return drawn.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).where(F.col("_before") < enough).drop("_size", "_draw", "_before")


def within(pieces: DataFrame, per: str, order: str, size: Column, budget: int) -> DataFrame:
    """The first pieces of each group whose sizes together stay within ``budget``: a prefix, cut where the running sum passes it."""
    so_far = Window.partitionBy(per).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return pieces.withColumn("_so_far", F.sum(F.coalesce(size, F.lit(0))).over(so_far)).where(F.col("_so_far") <= budget).drop("_so_far")


def by_length(rows: DataFrame, key: str, tokens: str, prompts: DataFrame, border: int = 512, n_short: int = 50, n_long: int = 50, seed: str = "latency") -> DataFrame:
    """Short and long rows (under ``border`` tokens and from there on) that have a prompt: so many of each, by hash, with ``long``."""
    known = rows.where(F.col(tokens).isNotNull()).join(prompts.select(key).distinct(), key, "left_semi").withColumn("long", F.col(tokens) >= border)
    drawn = known.withColumn("_n", F.row_number().over(Window.partitionBy("long").orderBy(draw(F.col(key), seed), key)))
    return drawn.where(F.col("_n") <= F.when(F.col("long"), n_long).otherwise(n_short)).drop("_n")
