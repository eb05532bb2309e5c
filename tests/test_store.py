"""A keyed table against a dictionary, files that stay where they are, and a cache that computes nothing twice."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factledger.operators import retrieval
from factledger.sources.store import KeyedTable, cached

SCHEMA = "id long, text string, tags array<string>"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, [t] if t else None) for i, t in rows], SCHEMA)


def rows(frame):
    return {r["id"]: r["text"] for r in frame.collect()}


def files(path):
    return {str(p) for p in Path(path).rglob("*.parquet")}


def test_changes_against_a_dictionary(spark, tmp_path):
    """Random upserts and deletes, of repeated and absent ids, with compactions in between."""
    table, want, rnd = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, buckets=5), {}, random.Random(4)
    assert table.read().count() == 0 and table.get(frame(spark, [(1, "")])).count() == 0
    for step in range(7):
        ids = [rnd.randrange(30) for _ in range(12)]
        if step % 3 == 2:
            table.delete(frame(spark, [(i, None) for i in [*ids, ids[0], 99]]))
            for i in ids:
                want.pop(i, None)
        else:
            new = {i: f"{step}/{i}" for i in ids}
            table.upsert(frame(spark, [*new.items(), (ids[0], new[ids[0]]), (None, "no id")]))
            want |= new
        if step in (3, 5):
            table.compact()
        assert rows(table.read()) == want
        asked = [rnd.randrange(40) for _ in range(6)]
        assert rows(table.get(frame(spark, [(i, None) for i in [*asked, None]]))) == {i: want[i] for i in asked if i in want}
    assert all(r["tags"] == [r["text"]] for r in table.read().collect())


def test_compaction_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, SCHEMA, buckets=8)
    table.upsert(frame(spark, [(i, "a") for i in range(40)]))
    before = files(path)
    table.upsert(frame(spark, [(3, "b")]))
    touched = {Path(f).parent.name for f in files(path) - before}
    assert len(touched) == 1 and table.compact() == 1
    assert {f for f in before if Path(f).parent.name not in touched} == {f for f in files(path) if Path(f).parent.name not in touched}
    assert not {f for f in before if Path(f).parent.name in touched} & files(path)
    assert rows(table.read()) == {**{i: "a" for i in range(40)}, 3: "b"} and table.compact() == 0
    table.delete(frame(spark, [(i, None) for i in range(40)]))
    table.compact()
    assert table.read().count() == 0


def test_get_reads_only_its_buckets(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, buckets=8)
    table.upsert(frame(spark, [(i, "a") for i in range(40)]))
    plan = table.get(frame(spark, [(3, None)]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_cache(spark, tmp_path):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)], "id long, embedding array<double>")
    calls = []

    def compute(missing):
        asked = missing.select(F.col("query").cast("long").alias("id"), "key").join(vectors, "id")
        calls.append(asked.count())
        found = retrieval.nearest(vectors, asked.select("id", "embedding"), 3).join(asked.select("key", F.col("id").alias("query_id")), "query_id")
        return found.selectExpr("key", "row_number() OVER (PARTITION BY key ORDER BY similarity DESC, vec_id) AS rank", "vec_id", "similarity")

    def ask(ids, version="v1", **settings):
        queries = spark.createDataFrame([(str(i), "plain", i) for i in ids], "query string, kind string, mine long")
        out = cached(queries, compute, str(tmp_path / "cache"), "vec_id long, similarity double", {"k": 3, **settings}, version)
        return {(r["query"], r["mine"]): [(x["vec_id"], x["similarity"]) for x in r["results"]] for r in out.collect()}

    first = ask([1, 2, 2])
    assert calls == [2] and all(len(x) == 3 for x in first.values())
    assert ask([1, 2]) == first and calls == [2, 0]  # nothing is computed again
    assert ask([1, 2, 3]).keys() == {("1", 1), ("2", 2), ("3", 3)} and calls[-1] == 1
    assert ask([1], version="v2") and calls[-1] == 1 and ask([1], k=4) and calls[-1] == 1
    assert ask([999]) == {("999", 999): []} and ask([999]) == {("999", 999): []}  # no hits are remembered too


def test_vectors_of_other_lengths(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0]), (4, []), (5, None), (6, [2.0]), (7, [0.0, 0.0])], "id long, embedding array<double>")
    found = sorted((r["query_id"], r["vec_id"]) for r in retrieval.nearest(vectors, vectors, 2).collect())
    assert found == [(1, 2), (2, 1), (3, 6), (6, 3)]
    assert retrieval.nearest(vectors, vectors.limit(0), 2).count() == 0


@pytest.mark.parametrize("n", [0, 3])
def test_gate_without_tokens(spark, n):
    queries = spark.createDataFrame([(0, "the of"), (1, "")] + [(i + 2, "net sales rose") for i in range(n)], "query_id long, text string")
    docs = spark.createDataFrame([(1, "sales rose by half"), (2, None), (3, "")], "id long, text string")
    assert sorted((r["query_id"], r["id"]) for r in retrieval.gate(queries, docs, 0.5).collect()) == [(i + 2, 1) for i in range(n)]
