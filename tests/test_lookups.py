"""Look-ups, samples, budgets, counted filters and record shapes on nulls, ties, repeats and empty tables."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from factledger import plans
from factledger.operators import lookups, sampling, structure
from factledger.operators.review import prompt_sections
from factledger.sources import tables


def test_the_last_record_owns_a_chunk(spark):
    rows = [("a", ["x", "y", None], 1), ("b", ["x"], 2), ("c", ["y", "y"], 1), ("d", None, 9), (None, ["z"], 3), ("e", [], 4)]
    frame = spark.createDataFrame(rows, "rec string, ids array<string>, at int")
    assert {r["chunk_id"]: r["record"] for r in lookups.owners(frame, "rec", "ids", "at").collect()} == {"x": "b", "y": "c", "z": None}
    assert lookups.owners(frame.limit(0), "rec", "ids", "at").count() == 0


def test_two_names(spark):
    rows = spark.createDataFrame([("p", "p_1"), ("q", "q_1"), ("r", "r_1"), ("s", "s"), (None, "t_1"), (None, None), ("p", "p_1")], "base string, raw string")
    table = spark.createDataFrame([("p", "P"), ("p_1", "no"), ("q", None), ("q_1", "Q1"), ("s", "S"), ("t_1", "T1"), (None, "null")], "id string, meta string")
    found = sorted((str(r["base"]), str(r["raw"]), str(r["meta"])) for r in lookups.look_up(rows, [F.col("base"), F.col("raw")], table, "id", "meta").collect())
    assert found == sorted([("p", "p_1", "P"), ("p", "p_1", "P"), ("q", "q_1", "Q1"), ("r", "r_1", "None"), ("s", "s", "S"), ("None", "t_1", "T1"), ("None", "None", "None")])


def test_schema_context(spark):
    facts = spark.createDataFrame([("r1", "b", "2023"), ("r1", "a", "2022"), ("r1", "c", None), ("r1", "c", "2022"), ("r2", "a", None), (None, "d", "2020"), (None, "d", None), (None, "d", None), (None, "d", None), ("r3", None, None)], "record string, metric string, period string")
    requests = spark.createDataFrame([(1, "r1"), (2, "r2"), (3, None), (4, "unknown")], "request_id int, record string")
    out = {r["request_id"]: (r["metrics"], r["periods"]) for r in lookups.schema_context(facts, requests, most=2, most_overall=3).collect()}
    every = ["2020", "2022", "2023"]
    assert out == {1: (["c", "a"], ["2022", "2023"]), 2: (["a"], every), 3: (["d", "a", "c"], every), 4: ([], every)}
    assert {(tuple(r["metrics"]), tuple(r["periods"])) for r in lookups.schema_context(facts.limit(0), requests).collect()} == {((), ())}


@pytest.mark.parametrize("parts", [1, 7])
def test_samples_do_not_hang_on_the_partitioning(spark, parts):
    rows = spark.createDataFrame([(i, f"g{i % 3}", i % 5) for i in range(200)] + [(None, "g0", None)], "id long, g string, size int").repartition(parts)
    some = {r["id"] for r in sampling.smallest(rows, "id", 17, "s").collect()}
    drawn = lambda i: hashlib.md5(f"s{'' if i is None else i}".encode()).hexdigest()
    assert some == set(sorted([None, *range(200)], key=drawn)[:17])
    each = sampling.smallest(rows, "id", 5, "s", per="g").groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in each} == {"g0": 5, "g1": 5, "g2": 5}
    drawn = sampling.pool(rows, "id", F.col("size"), 30, "s").collect()
    assert 30 <= sum(r["size"] for r in drawn) < 35 and all(r["size"] for r in drawn)
    assert sampling.pool(rows, "id", F.col("size"), 10**6, "s").count() == 160 and sampling.pool(rows.limit(0), "id", F.col("size"), 5).count() == 0
    plan = sampling.smallest(rows, "id", 17)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_budgets_cut_a_prefix(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 3, 6), ("a", 4, 1), ("b", 1, 99)], "g string, k int, n int")
    assert [(r["g"], r["k"]) for r in sampling.within(rows, "g", "k", F.col("n"), 11).orderBy("g", "k").collect()] == [("a", 1), ("a", 2), ("a", 3)]


def test_latency_sample(spark):
    rows = spark.createDataFrame([(i, 100 + 10 * i) for i in range(100)] + [(200, None)], "row_id long, tokens int")
    out = sampling.by_length(rows, "row_id", "tokens", spark.range(0, 300, 2).withColumnRenamed("id", "row_id"), n_short=7, n_long=9).collect()
    assert sum(r["long"] for r in out) == 9 and sum(not r["long"] for r in out) == 7 and all(r["row_id"] % 2 == 0 and r["long"] == (r["tokens"] >= 512) for r in out)


def test_counted(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 10 == 0 else i % 4) for i in range(50)], "id int, v int")
    kept, seen = lookups.counted(rows, {"first": F.col("v") > 0, "second": F.col("id") > 20}, "counts")
    kept.write.parquet(str(tmp_path / "k"))
    first = [i for i in range(50) if i % 10 == 0 or i % 4 == 0]
    second = [i for i in range(50) if i not in first and i <= 20]
    assert seen.get == {"rows": 50, "kept": 50 - len(first) - len(second), "dropped_first": len(first), "dropped_second": len(second)}
    assert spark.read.parquet(str(tmp_path / "k")).count() == seen.get["kept"] and kept.columns == ["id", "v"]


def test_shapes_in_one_file(spark, tmp_path):
    lines = ['{"q": "a", "n": 1}', '{"prompt": {"text": "b"}}', "broken", '{"q": "c"}', '{"q": "d", "n": "x"}', "", '{"q": "e", "n": 5, "prompt": {"text": "f"}}', "[1]", "null"]
    (tmp_path / "f.jsonl").write_text("\n".join(lines))
    shapes = {"one": {"query": ("$.q", "string"), "n": ("$.n", "int")}, "two": {"query": ("$.prompt.text", "string")}}
    out = tables.shaped(spark.read.text(str(tmp_path)), shapes)
    assert sorted((r["shape"] or "", r["query"] or "", r["n"] or 0) for r in out.collect()) == sorted([("one", "a", 1), ("two", "b", 0), ("one", "e", 5)] + [("", "", 0)] * 6)


def test_side_files(spark, tmp_path):
    rows = spark.createDataFrame([("b", (1, ["x"])), ("a", (2, [])), (None, (3, []))], "key string, value struct<n: int, records: array<string>>")
    tables.write_object(rows, "key", "value", str(tmp_path / "o"))
    assert {r["key"]: (r["value"]["n"], r["value"]["records"]) for r in tables.read_object(spark, str(tmp_path / "o"), "struct<n: int, records: array<string>>").collect()} == {"a": (2, []), "b": (1, ["x"])}


def pieces_by_hand(text, most):
    """Sentence by sentence, a long one word by word."""
    out, now = [], ""
    for s in re.split(r"(?<=[.!?])\s+", text.strip()):
        if len(s) > most and not len(now) + len(s) + 1 <= most:
            out, now = out + [now] * bool(now), ""
        for p in [s] if len(s) <= most else s.split():
            if len(now) + len(p) + 1 <= most:
                now = f"{now} {p}".strip()
            else:
                out, now = out + [now] * bool(now), p
    return out + [now] * bool(now)


def test_sentence_pieces(spark):
    rnd = random.Random(3)
    for _ in range(3000):
        text, most = "".join(rnd.choice("ab. !  \n") for _ in range(rnd.randint(13, 60))), rnd.randint(1, 12)
        assert structure.sentence_pieces(text, most) == (pieces_by_hand(text, most) or [text]), (text, most)
    assert structure.sentence_pieces("x" * 10_000) == ["x" * 10_000] and structure.sentence_pieces("a b") == ["a b"]
    long = structure.sentence_pieces("word " * 5_000 + "End. Next one.")
    assert max(map(len, long)) <= 1500 and " ".join(long).split() == ("word " * 5_000 + "End. Next one.").split()


def test_token_budgets(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    frame = spark.createDataFrame([("The quick brown fox jumps over it. é😀",), ("",), (None,)], "text string")
    rows = frame.select("text", structure.token_counter(path)("text").alias("n"), structure.token_prefix(path, 3)("text").alias("cut")).collect()
    assert rows[0]["text"].startswith(rows[0]["cut"]) and 0 < len(rows[0]["cut"]) < 25 and rows[0]["n"] > 8
    assert tuple(rows[1])[1:] == (0, "") and tuple(rows[2])[1:] == (None, None)
    assert spark.createDataFrame([(rows[0]["cut"],)], "text string").select(structure.token_counter(path)("text")).first()[0] == 3


def test_sections(spark):
    head = "QUESTION (THIS DOES NOT COUNT AS BACKGROUND INFORMATION):\n"
    prompts = [f"{head} q? \n--\nDOCUMENT:\n d\nANSWER:\nin\n--\nANSWER:\n a \n --", "ANSWER:\nfirst\n--\nDOCUMENT:\nx\n--\nANSWER:\nsecond\n--", f"{head}open", "", None]
    out = [tuple(r["s"]) if r["s"] else None for r in spark.createDataFrame([(p,) for p in prompts], "p string").select(prompt_sections(F.col("p")).alias("s")).collect()]
    assert out == [("q?", "d\nANSWER:\nin", "in"), ("", "x", "first"), ("", "", ""), ("", "", ""), ("", "", "")]


def test_numbers_of_parts_with_keys_of_seven_digits(spark, tmp_path):
    """Cleaned numbers are those of the query's SQL where keys outgrow six digits."""
    rows = [(k, "a part", size, 900.0 + size) for k in (0, 7, 999_999, 1_000_000, 1_234_567, 98_765_432_101) for size in (3, 5, 8, 11, 12, 14)] + [(None, "a part", 3, None), (5, None, None, 1.0)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    have = [tuple(r) for r in plans.QUERIES["cleaned_numbers"](spark, str(tmp_path)).select("p_partkey", "value").collect()]
    assert sorted(have, key=str) == sorted(con.execute(f"SELECT p_partkey, value FROM ({plans.ORACLES['cleaned_numbers']})").fetchall(), key=str)
