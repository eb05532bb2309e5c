"""The index against the exact search: all cells that count are read, and few are enough where vectors have a structure."""

import numpy as np
import pytest

from factledger.operators import retrieval, vector_index


def rows(frame):
    return sorted((r["query_id"], r["vec_id"], r["similarity"]) for r in frame.collect())


@pytest.mark.parametrize("block", [(20_000, 2_000), (50, 7)])
def test_exact_search_equals_all_pairs(spark, block, monkeypatch):
    """One cell with half of all vectors, ties, repeats, vectors without a direction and of other lengths; small groups too."""
    monkeypatch.setattr(vector_index, "CELL_ROWS", block[0])
    monkeypatch.setattr(vector_index, "QUERY_ROWS", block[1])
    rnd = np.random.default_rng(3)
    points = np.concatenate([rnd.normal(size=(100, 5)), [1, 0, 0, 0, 0] + 0.05 * rnd.normal(size=(150, 5)), np.repeat([[0, 0, 1.0, 0, 0]], 10, axis=0)])
    vectors = [(i, p.tolist()) for i, p in enumerate(points)] + [(900, None), (901, []), (902, [0.0] * 5), (903, [1.0, 2.0]), (None, [1.0] * 5)]
    frame = spark.createDataFrame(vectors, "id long, embedding array<double>")
    queries = frame.where("id % 3 = 0 OR id >= 900 OR id IS NULL")
    index = vector_index.build(frame, cells=8)
    assert index.sizes.sum() == 260
    want = rows(retrieval.nearest(frame.where("size(embedding) = 5"), queries.where("size(embedding) = 5"), 4))
    assert rows(vector_index.search(index, queries, 4, probes=2, exact=True)) == want


def test_recall(spark):
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(20, 16))
    points = centres[rnd.integers(0, 20, 1500)] + 0.25 * rnd.normal(size=(1500, 16))
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, embedding array<double>")
    index, queries = vector_index.build(frame, cells=16, sample_rows=400), frame.where("id % 25 = 0")
    exact = retrieval.nearest(frame, queries, 5)
    assert vector_index.recall(vector_index.search(index, queries, 5, probes=4), exact) >= 0.9
    given = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id AS id", "embedding")
    asked = given.where("id % 50 = 0")
    assert vector_index.recall(vector_index.search(vector_index.build(given), asked, 5), retrieval.nearest(given, asked, 5)) >= 0.9


def test_nothing_to_search(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    index = vector_index.build(frame)
    assert vector_index.search(index, frame, 3).count() == 0 and vector_index.search(index, frame.limit(0), 3, exact=True).count() == 0
    assert vector_index.search(vector_index.build(frame.limit(0)), frame, 3).count() == 0
