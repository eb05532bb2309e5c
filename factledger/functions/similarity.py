"""Similarity of strings by their longest common subsequence, bit-parallel; used in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def letter_bits(text: str) -> dict[str, int]:
    """For each character the bits of its places."""
    bits: dict[str, int] = {}
    for i, c in enumerate(text):
        bits[c] = bits.get(c, 0) | 1 << i
    return bits


def common_length(bits: dict[str, int], size: int, other: Iterable[str]) -> int:
    """Length of the longest common subsequence of a text of ``size`` characters (as ``letter_bits``) and another.

    A zero bit is a step up in the row of the usual table; one character of the other text updates the row by four operations on whole numbers.
    """
    every = (1 << size) - 1
    row = every
    for c in other:
        if hit := row & bits.get(c, 0):
            row = ((row + hit) | (row - hit)) & every
    return size - row.bit_count()


def token_set_ratio(a: str, b: str) -> float:
    """How alike two texts are as sets of words, 0 to 100: words that both have count fully, and what is left of each is compared by its characters.

    100 where one set holds the other; 0 where either text has no word.
    """
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both, only_a, only_b = (" ".join(sorted(s)) for s in (left & right, left - right, right - left))
    if both and not (only_a and only_b):
        return 100.0
    glue = len(both) + bool(both)
    rate = lambda apart, whole: 100 - 100 * apart / whole if whole else 100.0
    apart = len(only_a) + len(only_b) - 2 * common_length(letter_bits(only_a), len(only_a), only_b)
    out = [rate(apart, 2 * glue + len(only_a) + len(only_b))]
    if both:  # against the common words alone
        out += [rate(1 + len(x), len(both) + glue + len(x)) for x in (only_a, only_b)]
    return max(out)


@F.pandas_udf(DoubleType())
def token_set(a: pd.Series, b: pd.Series) -> pd.Series:
    """``token_set_ratio`` of two columns; null for a null."""
    return pd.Series([None if x is None or y is None else token_set_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
