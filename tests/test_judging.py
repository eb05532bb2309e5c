"""Failure predicates one by one, validation, groundedness, tables and opposite terms on odd rows."""

from pyspark.sql import functions as F

from factledger.operators import judging as J

KINDS = "answer string, gold string, label string, lookup boolean, context string, run string, code_ok boolean, finish_reason string, source string, golden array<string>, retrieved array<string>, indexed array<string>, warned boolean, bleed boolean"
BASE = {"answer": "It is 7", "gold": "12", "label": "Supported", "context": f"# LEDGER 7 {J.CHUNKS} 5", "run": "run_1", "golden": ["a"], "retrieved": ["a", "b"], "indexed": ["a"]}


def test_failures_one_by_one(spark):
    cases = [
        ({"answer": "It is 12.05"}, "NONE"), ({"answer": "TIMEOUT_FAILURE"}, "TYPE_7_GENERATION_FAILURE"), ({"run": "run_3"}, "TYPE_7_GENERATION_FAILURE"), ({"finish_reason": "max_tokens hit"}, "TYPE_7_GENERATION_FAILURE"),
        ({"source": "TATQA x", "answer": "Goodwill is 7"}, "TYPE_6_GOLD_AMBIGUITY"), ({"indexed": None}, "TYPE_5_COVERAGE_GAP"), ({"retrieved": ["b"]}, "TYPE_1_RETRIEVAL_BLINDNESS"),
        ({"gold": "the board", "run": "run_3", "code_ok": True}, "TYPE_4_MODALITY_MISMATCH"), ({"answer": "No information on 7"}, "TYPE_1_RETRIEVAL_BLINDNESS"), ({"warned": True}, "TYPE_1_RETRIEVAL_BLINDNESS"),
        ({"context": "12 and 7"}, "TYPE_3_ARITHMETIC_HALLUCINATION"), ({"bleed": True}, "TYPE_0_UFL_BLEED"), ({"bleed": True, "code_ok": True}, "TYPE_2_GENERATIVE_CONFLATION"), ({"bleed": True, "answer": "5"}, "TYPE_2_GENERATIVE_CONFLATION"),
        ({}, "TYPE_2_GENERATIVE_CONFLATION"), ({"gold": "the board"}, "TYPE_2_GENERATIVE_CONFLATION"), ({"golden": None, "retrieved": None, "indexed": None}, "TYPE_2_GENERATIVE_CONFLATION"),
        ({"gold": "13 and 12", "context": "12", "answer": "9"}, "TYPE_2_GENERATIVE_CONFLATION"),
    ]
    names = [c.split()[0] for c in KINDS.split(", ")]
    rows = spark.createDataFrame([(i, *((BASE | c).get(n) for n in names)) for i, (c, _) in enumerate(cases)], f"id int, {KINDS}")
    found = {r["id"]: r["f"] for r in rows.select("id", J.failure(rows, ("run_3",)).alias("f")).collect()}
    assert found == {i: want for i, (_, want) in enumerate(cases)}
    nothing = spark.createDataFrame([tuple([None] * len(names))], KINDS)
    assert nothing.select(J.failure(nothing, ("run_3",)).alias("f")).first()["f"] == "TYPE_2_GENERATIVE_CONFLATION"


def test_validation(spark):
    rows = [
        ("a", "Supported", True, "q", ["c"], "x = 1", None), ("b", "General", True, "", [], "x = (", None), ("sabotaged_c", "Unfounded", True, None, None, "# NO_TRACE_AVAILABLE", None),
        ("sabotaged_d", "Unfounded", True, "q", ["c"], "# TRACE_GENERATION_ERROR", "info"), ("e", None, None, None, None, "x", None), (None, None, True, "q", ["c"], "\x00", None),
    ]
    frame = spark.createDataFrame(rows, "id string, label string, has_inputs boolean, query string, context_chunks array<string>, trace string, sabotage string")
    assert {r["check"]: r["n"] for r in J.validation_stats(frame).collect()} == {
        "total_rows": 6, "schema_errors": 1, "empty_query": 2, "empty_context": 1, "valid_traces": 1, "trace_syntax_errors": 2, "no_trace": 1, "trace_errors": 1, "label_Supported": 1, "label_General": 1, "label_Unfounded": 2,
        "label_None": 1, "missing_sabotage_info": 1,
    }
    assert J.validation_stats(frame.limit(0)).count() == 0


def test_groundedness(spark):
    sentences = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, None), (3, "d")], "answer int, s string")
    judged = spark.createDataFrame([("a", "GROUNDED", None), ("b", "GROUNDED", "timeout"), ("d", "COMMON", None)], "s string, prediction string, error string")
    assert {r["answer"]: (r["sentences"], r["groundedness"]) for r in J.groundedness(sentences, judged, "answer", "s").collect()} == {1: (3, 0.333333), 2: (0, 0.0), 3: (1, 0.0)}


def test_tables(spark):
    cases = {
        "a | b\n---": False, "a | b | c\n---|---|---": True, "1,2,3,4\n1,2,3,4\nx": True, "1,2,3,4\nx\ny": False, "a\tb\tc\td\na\tb\tc\td\nz": True, "1 2 3\n4 5 6\n7 8 9": True, "a|b|c\nd|e|f\ng|h|i\nx": True,
        "a|b\nc|d\ne|f": False, "a|b|c\nd|e|f\ng|h": False, "": False, "    \n \n  \n": False,
    }
    frame = spark.createDataFrame([(k,) for k in [*cases, None]], "t string")
    assert {r["t"]: r["x"] for r in frame.select("t", J.looks_tabular(F.col("t")).alias("x")).collect()} == {**cases, "a | b\n---": False, None: False}


def test_opposites(spark):
    rows = [("Net income and revenue", "net LOSS, cost of revenues"), ("revenue", "Cost of revenue and cost of goods sold"), ("", "net loss"), (None, None)]
    out = [tuple(r["b"]) for r in spark.createDataFrame(rows, "q string, c string").select(J.opposite_terms(F.col("q"), F.col("c")).alias("b")).collect()]
    assert out == [(3, 1, 1 / 3), (2, 2, 1.0), (0, 0, 0.0), (0, 0, 0.0)]
    runs = spark.createDataFrame([("a", 0.123), ("a", None), ("b", None)], "run string, rate double")
    assert {r["run"]: r["mean"] for r in J.made_up_rates(runs, "run", "rate").collect()} == {"a": "12.30%", "b": "N/A"}
