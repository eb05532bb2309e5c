"""Traces and reviewers' views: cases that the queries don't have."""

import pytest
from pyspark.sql import functions as F

from factledger.functions import traces
from factledger.operators import review


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw,want", [("10%", "0.1"), ("1,000%", "10.0"), ("(500)", "-500"), ("$1,204.5", "1204.5"), ("", "0"), (" ", "0"), ("abc%", "abc%"), ("£7", "7"), ("none", "none")]
)
def test_number_text(spark, raw, want):
    assert one(spark, traces.number_text(F.col("s")), s=raw) == want


@pytest.mark.parametrize(
    "program,want",
    [
        ("add(1, 2)", "step_0 = 1 + 2\nprint(step_0)"),
        ("multiply(607, 18.13), multiply(#0, const_1000)", "step_0 = 607 * 18.13\nstep_1 = step_0 * 100\nprint(step_1)"),
        ("greater(const_10, const_0), less(#x, const_3)", "step_0 = 1 > 0\nstep_1 = #x < 3\nprint(step_1)"),
        ("table_min(row, none), noise, odd()", "step_0 = min([table_value(row), table_value(none)])\nprint(step_0)"),
        ("odd()", "step_0 = odd(0, 0)\nprint(step_0)"),
        ("", "# NO_TRACE_AVAILABLE"),
    ],
)
def test_programs(spark, program, want):
    assert one(spark, traces.program_trace(F.col("s")), s=program) == want


def test_tables(spark):
    assert one(spark, traces.markdown(F.array(F.array(F.lit("a"), F.lit(None).cast("string"))))) == "| a |  |\n| --- | --- |\n"
    assert one(spark, traces.markdown(F.array().cast("array<array<string>>"))) == ""


def test_answers_cut_off_and_empty(spark):
    assert tuple(one(spark, review.before_verdict(F.col("s")), s="<think>x</think>")) == ("", 0)
    assert tuple(one(spark, review.before_verdict(F.col("s")), s="label:  General.")) == ("General.", 2)
    assert tuple(one(spark, review.reasoning_parts(F.array(F.lit("a.")))))[1] == "a."


def test_columns(spark):
    frame = spark.range(1).select(F.struct(F.struct(F.lit(1).alias("c")).alias("b"), F.lit(2).alias("d.e")).alias("a"), F.lit(3).alias("n_tokens"), F.lit(5).alias("tokens.x"))
    assert review.flat(frame).columns == ["a.b.c", "a.d.e", "n_tokens", "tokens.x"]
    assert tuple(review.token_averages(frame).first()) == (3.0, 5.0)
    assert review.shown(frame, ("tokens.x", "n_tokens", "gone")[1:]).columns == ["n_tokens"]
