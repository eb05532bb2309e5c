"""Two passes of packing, first ids of groups, rows of a subsample."""

from pyspark.sql import functions as F

from factledger.operators import evaluation, ingest


def test_what_is_done_goes_first(spark):
    rows = [("a", 1, 5, None), ("a", 2, 4, True), ("a", 3, 9, True), ("a", 4, 6, True), ("a", 5, 1, False), ("b", 6, 10, None), ("b", 7, 11, True), (None, 8, 1, None)]
    out = {r["id"]: r["taken"] for r in ingest.pack_done_first(spark.createDataFrame(rows, "g string, id long, size int, done boolean"), "g", 10).collect()}
    assert out == {1: False, 2: True, 3: False, 4: True, 5: False, 6: True, 7: False, 8: True}


def test_first_ids_and_pairs(spark):
    rows = spark.createDataFrame([("x", i) for i in range(30)] + [("y", 1), (None, 5)], "g string, id long")
    out = {r["g"]: (r["n"], r["ids"]) for r in evaluation.first_ids(rows, "g", "id").collect()}
    assert out == {"x": (30, list(range(20))), "y": (1, [1])}
    pools = spark.createDataFrame([("p", True), ("p", None), ("q", True), (None, True)], "pool string, subsample boolean")
    assert evaluation.pairs_only(pools, ("p",)).count() == 1 and evaluation.pairs_only(pools.where(F.lit(False)), ("p",)).count() == 0
