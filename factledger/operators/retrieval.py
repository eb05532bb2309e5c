"""Retrieval: nearest vectors, the lexical gate over a corpus, expansions and ranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.functions import text
from factledger.operators.ledger import first_of, top_of


FOUND = "query_id long, vec_id long, similarity double"


def nearest(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6, block: int = 16_384) -> DataFrame:
    """query_id, vec_id, similarity: the k most cosine-similar vectors of each query, both sides (id, embedding).

    Queries go in blocks of about ``block`` vectors, one after the other, so what the driver holds and sends to tasks is bounded. A
    task keeps the best k of all its rows for each query. Ties on the rounded similarity go by id. The query itself is left
    out; null and zero vectors, and rows without an id, have no similarity, nor have two of different lengths. Without queries nothing is read. Several blocks need a checkpoint folder.
    """
    coded = queries.where("id IS NOT NULL AND embedding IS NOT NULL").select("id", "embedding")
    blocks = -(-coded.count() // block)
    if not blocks:
        return queries.sparkSession.createDataFrame([], FOUND)
    coded = coded.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    found = []
    for b in range(blocks):
        rows = coded.where(F.col("_block") == b).select("id", "embedding").collect()  # about ``block`` rows
        part = vectors.where("id IS NOT NULL").select("id", "embedding").mapInArrow(_block_search([(r["id"], r["embedding"]) for r in rows], k, digits), FOUND)
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
        part = part.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
        found.append(part.checkpoint() if blocks > 1 else part)
    return reduce(DataFrame.unionByName, found)


def _block_search(queries: list[tuple], k: int, digits: int, tile: int = 512):
    by_length: dict[int, list[tuple]] = {}
    for q in queries:
        by_length.setdefault(len(q[1]), []).append(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = {n: _Top(rows, k, digits) for n, rows in by_length.items()}
        for b in batches:
            embedded = b["embedding"].to_pylist()
            for n, top in tops.items():
                keep = [i for i, v in enumerate(embedded) if v is not None and len(v) == n]
                for at in range(0, len(keep), tile):
                    some = keep[at : at + tile]
                    top.add(b["id"].take(pa.array(some)).to_numpy(zero_copy_only=False), np.array([embedded[i] for i in some], np.float64).reshape(len(some), n))
        for top in tops.values():
            yield top.rows()

    return run


class _Top:
    """The best k rows so far for each of some queries of one length."""

    def __init__(self, queries: list[tuple], k: int, digits: int):
        self.ids, self.asked = np.array([q for q, _ in queries], np.int64), np.array([v for _, v in queries], np.float64).reshape(len(queries), -1)
        self.k, self.digits, self.lengths = k, digits, np.sqrt((self.asked * self.asked).sum(1))
        self.best, self.names = np.full((len(queries), k), -np.inf), np.zeros((len(queries), k), np.int64)

    def add(self, own: np.ndarray, matrix: np.ndarray) -> None:
        scale = self.lengths[:, None] * np.sqrt((matrix * matrix).sum(1))[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.round(self.asked @ matrix.T / scale, self.digits)
        score[(scale == 0) | (self.ids[:, None] == own[None, :])] = -np.inf
        better = np.flatnonzero(score.max(1) >= self.best[:, -1])  # the others keep what they have
        every = np.hstack((self.best[better], score[better]))
        known = np.hstack((self.names[better], np.broadcast_to(own, (len(better), len(own)))))
        order = np.lexsort((known, -every), axis=1)[:, : self.k]
        self.best[better], self.names[better] = np.take_along_axis(every, order, 1), np.take_along_axis(known, order, 1)

    def rows(self) -> pa.RecordBatch:
        good = np.isfinite(self.best)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, self.k)[good.ravel()]), pa.array(self.names[good]), pa.array(self.best[good])], ["query_id", "vec_id", "similarity"])


def gate(queries: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """query_id, id, recall for candidates that have at least ``threshold`` of a query's distinct tokens.

    A candidate that has enough of n tokens has one of the rarest n - ceil(threshold * n) + 1: only those are joined, and what
    they find is confirmed on whole token sets. Of the candidates' tokens only those that some query has are counted and moved; texts are taken
    apart once for that, and once more if they are to be confirmed. A query without tokens passes every text (see ``gated``, which
    decides given pairs); over a corpus that is no answer, so here it finds none.
    """
    asked = queries.select("query_id", F.array_distinct(text.tokens(F.col("text"))).alias("q")).where(F.size("q") > 0)
    parts = lambda c: F.array_distinct(text.tokens(text.strip_context(F.col(c))))
    wanted = asked.select("query_id", F.size("q").alias("n"), F.explode("q").alias("token"))
    each = candidates.select("id", F.explode(parts("text")).alias("token")).join(wanted.select("token").distinct(), "token", "left_semi").repartition("token")  # dealt once for the count and the join
    frequency = each.groupBy("token").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "token")
    ranked = wanted.join(frequency, "token", "left").withColumn("_n", F.row_number().over(rarest))
    few = ranked.where(F.col("_n") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("query_id", "token")
    pairs = few.join(each, "token").select("query_id", "id").distinct()
    have = candidates.join(pairs.select("id").distinct(), "id", "left_semi").select("id", parts("text").alias("w"))
    both = pairs.join(asked, "query_id").join(have, "id")
    recall = F.size(F.array_intersect("q", "w")) / F.size("q")
    return both.where(recall >= threshold).select("query_id", "id", F.round(recall, 6).alias("recall"))


def gated(pairs: DataFrame, threshold: float = text.GATE_THRESHOLD) -> DataFrame:
    """The (query, text) pairs that pass the gate; a query without tokens lets all pass."""
    return pairs.where(text.passes_gate(text.tokens(F.col("query")), F.col("text"), threshold))


def union_of_legs(legs: list[DataFrame], per: str, key: str) -> DataFrame:
    """Rows of several legs by (per, key); of equal keys the first leg's row stays."""
    every = None
    for n, leg in enumerate(legs):
        numbered = leg.withColumn("leg", F.lit(n))
        every = numbered if every is None else every.unionByName(numbered)
    return first_of(every, [per, key], "leg")


def related_chunks(hits: DataFrame, chunks: DataFrame, per: str, limit: int = 2) -> DataFrame:
    """For each related entity of a group's hits the first ``limit`` chunks of that entity."""
    asked = hits.where("related IS NOT NULL").select(per, "related").distinct()
    return top_of(asked.join(chunks, F.col("related") == F.col("entity")), [per, "related"], limit, "id")


def without_bleed(chunks: DataFrame, origins: DataFrame, prefix: Column) -> DataFrame:
    """``chunks`` with ``bleed``; chunks whose known origins have none with the prefix are bleed, unknown ones are not."""
    first = origins.groupBy("id").agg(F.collect_set("record").alias("_records"))
    joined = chunks.join(first, "id", "left")
    foreign = F.size("_records") > 0
    return joined.withColumn("bleed", F.coalesce(foreign & ~F.exists("_records", lambda r: F.startswith(r, prefix)), F.lit(False))).drop("_records")


def context_of(periods: DataFrame, record: str, year: str = r"^\d{4}$") -> DataFrame:
    """Each record's latest year and the one before; 2025 where no period is a year."""
    latest = F.max(F.when(F.col("period").rlike(year), F.col("period")))
    return periods.groupBy(record).agg(F.coalesce(latest, F.lit("2025")).alias("anchor")).withColumn("last_year", (F.col("anchor").cast("int") - 1).cast("string"))


def rank_chunks(chunks: DataFrame, linked: DataFrame, keywords: list[str], per: str, limit: int = 5) -> DataFrame:
    """The best ``limit`` chunks of each group: 5 points if linked to a fact, 1 for each keyword contained; then by id."""
    points = sum((F.contains(F.lower("text"), F.lit(k.lower())).cast("int") for k in keywords), F.lit(0))
    scored = chunks.join(linked.select(F.col("id"), F.lit(5).alias("_link")).distinct(), "id", "left").withColumn("score", F.coalesce("_link", F.lit(0)) + F.coalesce(points, F.lit(0)))
    order = Window.partitionBy(per).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("_link")


def expand_by_frequency(hits: DataFrame, present: DataFrame, per: str, key: str, limit: int = 3) -> DataFrame:
    """The most frequent keys among hits that aren't present yet."""
    counted = hits.groupBy(per, key).agg(F.count("*").alias("n")).join(present, [per, key], "left_anti")
    order = Window.partitionBy(per).orderBy(F.desc("n"), key)
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def base_chunk(chunk: Column) -> Column:
    """A chunk id without its four-digit sub-chunk suffix."""
    return F.regexp_replace(chunk, "_[0-9a-f]{4}$", "")


def bleed(rows: DataFrame, per: str, entity: str, asked: Column) -> DataFrame:
    """Per group: whether an entity was not asked for, or there are several."""
    return rows.groupBy(per).agg(
        F.bool_or(~asked).alias("foreign"), F.count_distinct(entity).alias("entities"), (F.bool_or(~asked) | (F.count_distinct(entity) > 1)).alias("bleed")
    )


def assemble(chunks: DataFrame, per: str) -> DataFrame:
    """One context text for each group, chunks in rank order."""
    block = F.concat(F.lit("--- CHUNK_ID: "), F.col("id").cast("string"), F.lit(" ---\n"), F.col("text"), F.lit("\n"))
    in_order = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return chunks.groupBy(per).agg(F.array_join(F.transform(in_order, lambda b: b["block"]), "\n").alias("context"))


def guarded_years(planned: Column, query: Column, implied: Column, year: str = r"20[0-9]{2}\b") -> Column:
    """Planned years that the query names or implies."""
    return F.array_intersect(planned, F.array_union(F.regexp_extract_all(query, F.lit(year), F.lit(0)), implied))
