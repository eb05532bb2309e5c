"""Registration of queries, and expressions that Spark and DuckDB compute alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.functions.text import STOP_WORDS
from factledger.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, oracle: str | None = None) -> Callable[[Callable], Callable]:
        """Register a function of a table loader under its own name."""

        def add(build: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
            self.queries[build.__name__] = lambda spark, sf_dir: build(lambda name: table(spark, sf_dir, name))
            if oracle:
                self.oracles[build.__name__] = oracle
            return build

        return add


def digest(seed: str, value: Column) -> Column:
    """A number from 0 to 65535 that stands in for a random draw."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), value.cast("string"))), 1, 4), 16, 10).cast("int")


def sql_digest(seed: str, value: str) -> str:
    return f"('0x' || substr(md5('{seed}' || ({value})::VARCHAR), 1, 4))::INT"


def sql_tokens(text: str) -> str:
    """Tokens by Unicode word boundaries, which RE2 has no sign for: whole words first, then those that are ASCII."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    words = rf"list_transform(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}\p{{M}}_&%/]+'), lambda t: trim(t, '&%/'))"
    return f"list_filter({words}, lambda t: regexp_full_match(t, '[a-z0-9&%/]+') AND len(t) > 1 AND t NOT IN ({stop}))"


SQL_LEDGER = """
  SELECT md5('ID_' || n_name || '_' || metric_name || '_' || period_end) AS row_id, 'ID_' || n_name AS entity_id, metric_name, num_value, period_end
  FROM (
    UNPIVOT (
      SELECT n_name, year(o_orderdate)::VARCHAR AS period_end,
        sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(4,2)))::DOUBLE AS Revenue,
        sum(l_quantity::DECIMAL(18,2))::DOUBLE AS Quantity,
        sum(l_discount::DECIMAL(18,2))::DOUBLE / count(*) AS "Average Discount"
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      GROUP BY ALL
    ) ON Revenue, Quantity, "Average Discount" INTO NAME metric_name VALUE num_value
  )
"""
