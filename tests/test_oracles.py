"""Every query gives the rows of its SQL, at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from factledger import plans
from factledger.operators import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return "null" if value is None else str(value)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_oracle(spark, duck, name):
    frame = plans.QUERIES[name](spark, SF)
    found = duck.execute(plans.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(frame.columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall())
    have = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in frame.collect())
    assert have == want


@pytest.mark.parametrize("name", ["exact_align", "exact_align_collapsed"])
def test_short_and_broken_quotes(spark, tmp_path, name):
    """Items of 0 to 8 words, cut within words, with other white space, and repeated rows."""
    texts = ["one two three four five six seven eight nine ten", "  one two\n\nthree four  five six seven eight\tnine", "bone two threefold", "é one two é two three", "", " ", None]
    docs = [(i, x) for i, x in enumerate(texts)] + [(0, texts[0]), (None, texts[0]), (1, texts[0])]
    words = texts[0].split()
    quotes = [" ".join(words[a : a + n])[c : None if c == 0 else -c] for n in range(9) for a in (0, 1) for c in (0, 1)]
    quotes += ["one  two", "two three\nfour five six seven eight", " two three ", "  one", None, "\n", quotes[-1]]
    items = [(i, q) for i, q in enumerate(quotes)] + [(3, quotes[3]), (None, "two three four five")]
    con = duckdb.connect()
    for table, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        spark.createDataFrame(rows, f"{key} long, text string").write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    found = con.execute(plans.ORACLES[name])
    columns = [d[0] for d in found.description]
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in plans.QUERIES[name](spark, str(tmp_path)).collect()) == want


def test_short_quotes_meet_only_texts_that_may_hold_them(spark):
    """No cartesian product or nested loop for quotes of one or two words, whether their keys are sent or joined; the same rows either way."""
    docs = spark.createDataFrame([(i, f"bone {i} two threefold one  two\n{i}") for i in range(50)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "thr"), (2, "one  t"), (3, "7"), (4, "é"), (5, "two threefold one"), (6, "wo three")], "item_id long, text string")
    found = []
    for sent in (50_000, 0):
        frame = ingest.align(items, docs, most_sent=sent)
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
        found.append(sorted(map(tuple, frame.collect())))
    assert found[0] == found[1] and {i for i, _, _ in found[0]} == {1, 2, 3, 5, 6}
    assert sum(i == 3 for i, _, _ in found[0]) == sum("7" in str(k) for k in range(50))


def test_every_query_has_sql():
    assert plans.QUERIES.keys() == plans.ORACLES.keys()


def test_plans_reach_the_scan(spark):
    """Only the needed columns are read, and filters reach the files."""
    plan = plans.QUERIES["nuance_focus"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan
    plan = plans.QUERIES["expand_facts_by_chunk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "text" not in plan.split("ReadSchema")[1]
