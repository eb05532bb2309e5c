"""Look-ups between chunks, records and schema summaries, and filters that count what they drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def owners(records: DataFrame, record: str, chunks: str, order: str) -> DataFrame:
    """chunk_id, record of each chunk that ``records`` (record, an array of chunk ids, order) lists; of several records the last one by ``order``, then by its id."""
    each = records.select(F.col(record).alias("record"), F.col(order).alias("_order"), F.explode(chunks).alias("chunk_id")).where("chunk_id IS NOT NULL")
    return each.groupBy("chunk_id").agg(F.max_by("record", F.struct("_order", "record")).alias("record"))


def look_up(rows: DataFrame, names: list[Column], table: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with ``value`` of ``table`` (key, value; keys unique) under the first of ``names`` that has one; null where none has.

    All names of a row go to one join; rows are told apart by a number, so equal rows stay.
    """
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    asked = numbered.select("_row", F.posexplode(F.array_distinct(F.array_compact(F.array(*names)))).alias("_turn", "_key"))
    found = asked.join(table.where(F.col(value).isNotNull()).select(F.col(key).alias("_key"), value), "_key")
    first = found.groupBy("_row").agg(F.min_by(value, "_turn").alias(value))
    return numbered.join(first, "_row", "left").drop("_row")


def schema_context(facts: DataFrame, requests: DataFrame, most: int = 500, most_overall: int = 100) -> DataFrame:
    """``requests`` (request_id, record) with ``metrics`` and ``periods`` of their record, from ``facts`` (record, metric, period).

    Metrics are the ``most`` most frequent ones of the record, ties by name; an unknown record has none. Without a record they are the first ``most_overall`` of all
    facts. Periods are the record's, sorted; all facts' where the record has none or is null. One pass counts both by record and overall.
    """
    by_metric = facts.where("metric IS NOT NULL").groupingSets([["record", "metric"], ["metric"]], "record", "metric").agg(F.count("*").alias("n"), F.grouping("record").alias("overall"))
    ranked = by_metric.withColumn("_n", F.row_number().over(Window.partitionBy("overall", "record").orderBy(F.desc("n"), "metric")))
    some = ranked.where(F.col("_n") <= F.when(F.col("overall") == 1, most_overall).otherwise(most))
    metrics = some.groupBy("overall", "record").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "metric"))), lambda m: m["metric"]).alias("metrics"))
    periods = (
        facts.where("period IS NOT NULL").groupingSets([["record", "period"], ["period"]], "record", "period").agg(F.grouping("record").alias("overall"))
        .groupBy("overall", "record").agg(F.array_sort(F.collect_list("period")).alias("periods"))
    )
    none = F.array().cast("array<string>")
    all_ = lambda frame: F.broadcast(frame.where("overall = 1").select(F.lit(1).alias("_one"), F.col(frame.columns[-1]).alias("_all")))  # noqa: E731 # one row
    own = lambda frame: frame.where("overall = 0 AND record IS NOT NULL").drop("overall")
    out = requests.withColumn("_one", F.lit(1)).join(own(metrics), "record", "left").join(all_(metrics), "_one", "left")
    out = out.withColumn("metrics", F.coalesce(F.when(F.col("record").isNull(), F.col("_all")).otherwise(F.col("metrics")), none)).drop("_all")
    out = out.join(own(periods), "record", "left").join(all_(periods), "_one", "left")
    return out.withColumn("periods", F.coalesce("periods", "_all", none)).select("request_id", "record", "metrics", "periods")


def counted(rows: DataFrame, rules: dict[str, Column], label: str = "filters") -> tuple[DataFrame, Observation]:
    """``rows`` that all ``rules`` keep, and what is counted in the pass that filters: rows, kept, and ``dropped_<rule>`` by the first rule that drops a row.

    The counts are there after the first action on the rows. A rule that is null drops.
    """
    drops = [~F.coalesce(rule, F.lit(False)) for rule in rules.values()]
    first = F.coalesce(*(F.when(d, F.lit(name)) for d, name in zip(drops, rules, strict=True)))
    seen = Observation(label)
    marked = rows.withColumn("_dropped", first)
    counts = [F.count("*").alias("rows"), F.count_if(F.col("_dropped").isNull()).alias("kept")]
    return marked.observe(seen, *counts, *(F.count_if(F.col("_dropped") == n).alias(f"dropped_{n}") for n in rules)).where("_dropped IS NULL").drop("_dropped"), seen


def first_category(value: Column, targets: tuple[str, ...]) -> Column:
    """The first of ``targets`` that a category contains, in any case; null for none."""
    return F.coalesce(*(F.when(F.contains(F.lower(value), F.lit(t.lower())), t) for t in targets))
