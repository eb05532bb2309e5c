r"""Chat formatting by prefix-target expansion, in SQL expressions only.

A turn is written as ``<s>[role]\n`` + text + ``</s>``. Inside roles and texts ``&``, ``<``, ``[`` and
``]`` become ``&amp;``, ``&lt;``, ``&#91;`` and ``&#93;``, so no text can form a control string (of this template
or of the usual ``[INST]``/``</s>`` ones) and the writing can be undone. Every assistant turn becomes an example: all turns
before it as context, then its own; the loss mask covers the reply's text alone. Turns after the last
reply, or a conversation without a reply, come as one example with an empty mask, so nothing is lost.

Turns are ordered by turn number (null last), then role, then text. Defined results: null text or role is empty;
a null conv_id is a conversation of its own; repeated rows are turns of their own; an empty table gives
no example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;"))


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def expand(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """conv_id, example (from 0), last, text, loss_start (code points from 0), loss_chars from (conv_id, turn, role, text)."""
    role, body = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role"), F.col("text"))
    pieces = (
        turns.select("conv_id", "turn", "role", "text", F.concat(F.lit("<s>["), role, F.lit("]\n")).alias("head"), body.alias("body"))
        .withColumn("piece", F.concat("head", "body", F.lit("</s>")))
        .withColumn("n", F.row_number().over(in_order))
        .withColumn("end", F.sum(F.length("piece").cast("long")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    turn = F.struct(
        "n",
        "piece",
        (F.coalesce("role", F.lit("")) == target_role).alias("target"),
        F.col("end").cast("int").alias("end"),
        F.length("body").alias("chars"),
    )
    whole = (
        pieces.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
        .withColumn("all", F.array_join(F.col("turns.piece"), ""))
        .withColumn("n_turns", F.size("turns"))
        .withColumn("ends", F.filter("turns", lambda t: t["target"] | (t["n"] == F.col("n_turns"))))
        .select("conv_id", "all", "n_turns", F.posexplode("ends").alias("example", "t"))
    )
    chars = F.when(F.col("t.target"), F.col("t.chars")).otherwise(0)
    return whole.select(
        "conv_id",
        "example",
        (F.col("t.n") == F.col("n_turns")).alias("last"),
        F.substring(F.col("all"), F.lit(1), F.col("t.end")).alias("text"),
        (F.col("t.end") - F.length(F.lit("</s>")) - chars).alias("loss_start"),
        chars.alias("loss_chars"),
    )


def masked(examples: DataFrame) -> DataFrame:
    """``examples`` with ``loss_text``: what the mask covers, unescaped."""
    return examples.withColumn("loss_text", unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_chars"))))


def parse(text: Column) -> Column:
    """array<struct<role, text>> of a formatted example."""
    pieces = F.split(text, "</s>")
    return F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(
            unescape(F.substring(F.substring_index(p, "]\n", 1), 5, 2_000_000_000)).alias("role"),
            unescape(F.substring(p, F.length(F.substring_index(p, "]\n", 1)) + 3, F.lit(2_000_000_000))).alias("text"),
        ),
    )
