"""Attacks in their order on single records and nulls; contrast sets with parents, priority and repeats."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from factledger import plans
from factledger.operators import attacks

COLUMNS = "id long, query string, answer string, trace string, context string, scale string, company string, cells array<struct<cell: string, neighbours: array<string>>>, distractor string"


def attacked(spark, **record):
    rows = [tuple(record.get(c.split()[0]) if c.split()[0] != "id" else i for c in COLUMNS.replace("array<struct<cell: string, neighbours: array<string>>>", "x").split(", ")) for i in range(8)]
    return [r["attack"] for r in attacks.attack(spark.createDataFrame(rows, COLUMNS)).collect()]


def test_order_of_attacks(spark):
    trace = {"trace": "add(70, 2)", "context": "only 80 and 70"}
    table = {"answer": "it was 15", "cells": [("15", [None, "x", "99"])]}
    assert {(a.kind, a.field, a.text) for a in attacked(spark, **trace, **table, query="in 2020")} == {("logic", "trace", "add(80, 2)")}
    assert {(a.kind, a.text) for a in attacked(spark, **table, query="in 2020", trace="# VERIFICATION f(70)", context="80")} == {("numeric_neighbor_trap", "it was 99")}
    both = {(a.kind, a.text) for a in attacked(spark, answer="in Million euros", query="in 2020", scale="million")}
    assert {k for k, _ in both} == {"irrelevancy", "semantic_drift"} and {t for _, t in both} <= {"in 2021", "in 2019", "in billion euros", "in thousand euros"}
    assert {(a.kind, a.field, a.text) for a in attacked(spark, query="no year", distractor="else")} == {("irrelevancy", "context", "else")}
    assert attacked(spark) == [None] * 8 and attacked(spark, answer="x", scale="dozen") == [None] * 8
    assert {a.text for a in attacked(spark, answer="The Acme sold", context="In May Bolt said")} == {"The Bolt sold"}
    assert {a.text for a in attacked(spark, answer="big co sold", company="big co", context="Bolt")} == {"Bolt sold"}
    assert {a.text for a in attacked(spark, answer="five", scale="percent", context="Bolt")} == {"five basis points"}


@pytest.mark.parametrize("general", [0, 3, 100])
def test_contrast_set(spark, general):
    rows = [(i, "Supported", None, "a") for i in range(100)] + [(i, "unfounded", None, "a") for i in range(100, 115)] + [(i, "Unfounded", i - 200, "b") for i in range(200, 260)]
    rows += [(i, " General", None, "c") for i in range(300, 300 + general)] + [(400, None, None, "d"), (401, "other", None, "d"), (None, "Supported", None, "a")]
    out = attacks.contrast_set(spark.createDataFrame(rows, "id long, label string, parent long, source string"), 100, priority=F.col("id") == 99).collect()
    hit = [r for r in out if r["parent"] is not None]
    assert len(hit) == 25 and sum(r["label"] == "unfounded" for r in out) == 15  # 20 and, since natural ones run out, 5 more
    supported = {r["id"] for r in out if r["label"] == "Supported"}
    assert len(supported) == 40 and {r["parent"] for r in hit} <= supported and 99 in supported
    copies = [r for r in out if r["label"] == " General"]
    assert len(copies) == (20 if general else 0) and len({(r["id"], r["copy"]) for r in copies}) == len(copies)
    assert attacks.contrast_set(spark.createDataFrame([], "id long, label string, parent long"), 100).count() == 0


def test_cells_that_stand_in_names_too(spark, tmp_path):
    """A price that is a part of the customer's number as well, once or twice: the query's rows are those of its SQL."""
    day = datetime.datetime(1998, 2, 6)
    orders = [(i, c, "O", float(p), day, "5-LOW") for i, (c, p) in enumerate([(14568, 14568.4), (14568, 20000.0), (33, 33.0), (33, 3.5), (33, 333.0), (7, 123.0), (12012, 12.9), (12012, 5.0)])]
    tables = {
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "customer": ([(c, f"Customer#{c:09d}", 1, 1.0, "BUILDING") for c in (14568, 33, 7, 12012)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "nation": ([(1, "NATION_1", 0)], "n_nationkey int, n_name string, n_regionkey int"),
    }
    con = duckdb.connect()
    for name, (rows, kinds) in tables.items():
        spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = sorted(con.execute(f"SELECT id, kind, field, text FROM ({plans.ORACLES['attack_cascade']})").fetchall())
    assert "Sold by Customer#000020000 for 20000 million in BUILDING by Acme" in {r[3] for r in want}
    assert sorted(tuple(r) for r in plans.QUERIES["attack_cascade"](spark, str(tmp_path)).select("id", "kind", "field", "text").collect()) == want
