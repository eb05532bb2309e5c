"""The fact ledger: building it from rows of business tables, and its structured filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.functions import text


def facts_by_entity_year(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Revenue, Quantity and Average Discount of each nation and order year, one row for each metric."""
    money = F.col("l_extendedprice").cast("decimal(18,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
    joined = (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    sums = joined.groupBy("n_name", F.year("o_orderdate").cast("string").alias("period_end")).agg(
        F.sum(money).cast("double").alias("Revenue"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("Quantity"),
        (F.sum(F.col("l_discount").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("Average Discount"),
    )
    long = sums.unpivot(["n_name", "period_end"], ["Revenue", "Quantity", "Average Discount"], "metric_name", "num_value")
    entity = text.entity_id(F.col("n_name"))
    return long.select(
        F.md5(F.concat_ws("_", entity, "metric_name", "period_end")).alias("row_id"), entity.alias("entity_id"), "metric_name", "num_value", "period_end"
    )


def in_entities(frame: DataFrame, entities: list[str], record: str | None = None) -> DataFrame:
    """Rows of the entities or the record; all rows where neither is given."""
    if entities and record is not None:
        return frame.where(F.col("entity_id").isin(entities) | F.col("source_record_id").eqNullSafe(record))
    if entities:
        return frame.where(F.col("entity_id").isin(entities))
    return frame if record is None else frame.where(F.col("source_record_id") == record)


def in_years(frame: DataFrame, years: list[str]) -> DataFrame:
    return frame.where(F.col("period_end").rlike("|".join(years))) if years else frame


def with_metrics(frame: DataFrame, whole: DataFrame, keywords: list[str]) -> DataFrame:
    """Exact metric names if any row of the whole ledger has one; else names that contain a keyword and pass the gate."""
    if not keywords:
        return frame
    exact = whole.agg(F.coalesce(F.bool_or(F.col("metric_name").isin(keywords)), F.lit(False)).alias("_exact"))
    asked = F.flatten(F.array(*(text.tokens(F.lit(k)) for k in keywords)))
    fuzzy = F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower("metric_name"), F.lower(k))) & text.passes_gate(asked, F.col("metric_name"))
    # one row on the right, by construction
    return frame.crossJoin(F.broadcast(exact)).where(F.when(F.col("_exact"), F.col("metric_name").isin(keywords)).otherwise(fuzzy)).drop("_exact")


def in_company(frame: DataFrame, label: Column, scope: str) -> DataFrame:
    """Rows of one company or of nobody in particular."""
    return frame.where(label.isin(scope, "EXP_GLOBAL", "Global_Entity"))


def aligned(frame: DataFrame, status: Column) -> DataFrame:
    return frame.where(~status.eqNullSafe(F.lit("UNALIGNED")))


def with_nuance(frame: DataFrame, nuance: Column, focus: str) -> DataFrame:
    return frame.where(F.coalesce(F.contains(F.lower(nuance), F.lit(focus.lower())), F.lit(False)))


def first_of(frame: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def top_of(frame: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= n).drop("_n")
