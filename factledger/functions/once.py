"""Values that an expression names several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once a row, however often ``use`` names it; within lambdas Spark works it out for every element again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
