"""A partitioned index of vectors: cells around centroids, searched near the query first, and exactly where asked.

Centroids are fitted on ``sample_rows`` vectors at most (those with the smallest hash of their id), which the driver holds; every vector is then dealt to its nearest
centroid in tasks. A search looks through the ``probes`` cells nearest to a query. That is approximate. To be exact, it goes on with each cell that could still hold one of the
k best: no vector of a cell is nearer to the query than the query's angle to the centroid less the cell's widest angle.

Cells and queries meet in groups of ``CELL_ROWS`` vectors and ``QUERY_ROWS`` queries at most, so a cell with a third of all vectors, or one that all queries ask
for, is work for many tasks. What the driver holds is the sample, and a number for each cell.

Vectors that are null, zero or of another length than the sample's first have no similarity and are left out, on both sides. Ids are unique; a query's own id is left out of its result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factledger.operators.sampling import smallest
from factledger.sources.store import scratch

CELL_ROWS, QUERY_ROWS = 20_000, 2_000
FOUND = "query_id long, vec_id long, similarity double"


@dataclass
class Index:
    """``rows``: id, embedding (of length one), cell. ``sizes`` and ``widths`` (widest angle) by cell."""

    rows: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    widths: np.ndarray


def fit(vectors: DataFrame, cells: int = 32, sample_rows: int = 20_000, rounds: int = 10) -> np.ndarray:
    """Unit centroids of at most ``cells`` cells: k-means by cosine, started from the sample's first vectors."""
    some = [r["embedding"] for r in smallest(vectors.where("id IS NOT NULL AND size(embedding) > 0").select("id", "embedding"), "id", sample_rows, "cells").collect()]
    points = np.array([v for v in some if len(v) == len(some[0])], np.float64).reshape(-1, len(some[0]) if some else 1)
    points = points[np.linalg.norm(points, axis=1) > 0]
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    centroids = points[:cells].copy()
    for _ in range(rounds):
        nearest = (points @ centroids.T).argmax(1) if len(points) else np.zeros(0, int)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.where(length > 0, length, 1), centroids)
    return centroids


def _units(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the rows that have a direction."""
    pairs = [(i, v) for i, v in zip(batch["id"].to_pylist(), batch["embedding"].to_pylist(), strict=True) if i is not None and v is not None and len(v) == dims]
    matrix = np.array([v for _, v in pairs], np.float64).reshape(len(pairs), dims)
    length = np.linalg.norm(matrix, axis=1)
    good = length > 0
    return np.array([i for i, _ in pairs], np.int64)[good], matrix[good] / length[good, None]


def build(vectors: DataFrame, cells: int = 32, sample_rows: int = 20_000) -> Index:
    """The index of ``vectors`` (id, embedding), written to the shared folder."""
    centroids = fit(vectors, cells, sample_rows)
    dims = centroids.shape[1]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, units = _units(b, dims)
            near = units @ centroids.T if len(centroids) else np.zeros((0, 1))
            cell = near.argmax(1)
            angle = np.arccos(np.clip(near.max(1, initial=-1), -1, 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(units), pa.list_(pa.float64())), pa.array(cell, pa.int32()), pa.array(angle)], names=["id", "embedding", "cell", "angle"])

    spark, path = vectors.sparkSession, scratch(vectors.sparkSession, "vector-index")
    vectors.select("id", "embedding").mapInArrow(deal, "id long, embedding array<double>, cell int, angle double").write.parquet(path)
    rows = spark.read.parquet(path)
    sizes, widths = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("w")).collect():  # a row for each cell
        sizes[r["cell"]], widths[r["cell"]] = r["n"], r["w"]
    return Index(rows.select("id", "embedding", "cell"), centroids, sizes, widths)


def search(index: Index, queries: DataFrame, k: int, probes: int = 24, exact: bool = False, digits: int = 6) -> DataFrame:
    """query_id, vec_id, similarity of the k nearest vectors that the probed cells hold, or of all with ``exact``; ties on the rounded similarity go by id."""
    first = best(_scan(index, _probe(index, queries.select("id", "embedding", F.lit(None).cast("double").alias("least")), 0, probes), k, digits), k)
    if not exact:
        return first
    path = scratch(queries.sparkSession, "vector-found")
    first.write.parquet(path)
    first = queries.sparkSession.read.parquet(path)
    worst = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("similarity").alias("s"))
    limits = queries.join(worst, F.col("id") == F.col("query_id"), "left").select("id", "embedding", F.when(F.col("n") >= k, F.col("s")).otherwise(-2.0).alias("least"))
    return best(first.unionByName(_scan(index, _probe(index, limits, probes, len(index.centroids)), k, digits)), k)


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def _probe(index: Index, queries: DataFrame, start: int, stop: int) -> DataFrame:
    """query_id, asked, cell: each query with its cells from the ``start``-th nearest up to the ``stop``-th that may hold a similarity of ``least``."""
    centroids, widths, filled = index.centroids, index.widths, index.sizes > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = dict(zip(b["id"].to_pylist(), b["least"].to_pylist(), strict=True))
            ids, units = _units(b, centroids.shape[1])
            angles = np.arccos(np.clip(units @ centroids.T, -1, 1))
            order = np.argsort(angles, axis=1, kind="stable")[:, start:stop]
            could = np.cos(np.clip(np.take_along_axis(angles, order, 1) - widths[order], 0, np.pi)) + 1e-6  # a similarity is rounded
            limit = np.array([-2.0 if least[i] is None else least[i] for i in ids.tolist()])
            row, col = np.nonzero((could >= limit[:, None]) & filled[order]) if len(ids) else (np.zeros(0, int), np.zeros(0, int))
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array([units[i] for i in row], pa.list_(pa.float64())), pa.array(order[row, col], pa.int32())], names=["query_id", "asked", "cell"])

    return queries.mapInArrow(run, "query_id long, asked array<double>, cell int")


def _scan(index: Index, asked: DataFrame, k: int, digits: int) -> DataFrame:
    """The k best of each group of a cell's vectors for each query that asks for the cell."""
    spark = asked.sparkSession
    path = scratch(spark, "vector-probes")
    asked.write.parquet(path)
    asked = spark.read.schema(asked.schema).parquet(path)
    askers = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}  # a row for each cell
    parts = [(c, max(1, -(-int(n) // CELL_ROWS)), max(1, -(-askers.get(c, 0) // QUERY_ROWS))) for c, n in enumerate(index.sizes) if askers.get(c)]
    dealt = F.broadcast(spark.createDataFrame(parts, "cell int, parts int, blocks int"))
    several = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = index.rows.join(dealt, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), several("blocks").alias("block"), "id", "embedding")
    wanted = asked.join(dealt, "cell").select("cell", several("parts").alias("part"), F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), "query_id", "asked")

    def meet(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        ids, names = vectors["id"].to_numpy(), queries["query_id"].to_numpy()
        if not len(ids) or not len(names):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        flat = lambda t, c: np.concatenate([x.flatten().to_numpy() for x in t[c].chunks]).reshape(t.num_rows, -1)
        matrix, out = flat(vectors, "embedding"), []
        for at in range(0, len(names), 256):
            score = np.round(flat(queries.slice(at, 256), "asked") @ matrix.T, digits)
            score[names[at : at + 256, None] == ids[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
            taken = np.take_along_axis(score, order, 1)
            row, col = np.nonzero(np.isfinite(taken))
            out.append((names[at : at + 256][row], ids[order[row, col]], taken[row, col]))
        return pa.table({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "similarity"), zip(*out), strict=True)})

    keys = ["cell", "part", "block"]
    return rows.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(meet, FOUND)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact result's pairs that were found."""
    both = exact.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    return both / max(1, exact.count())
