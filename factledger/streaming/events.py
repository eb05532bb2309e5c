"""Streaming jobs over event files: windowed counts, and a resumable append-only log."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from factledger.sources import tables


def read_events(spark: SparkSession, path: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and values by window and type; on a stream, rows later than ``late`` are left out."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    value = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    counted = timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), value.alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by user and session; a session ends when nothing came for ``gap``."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    counted = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("session_start"), "n")


class Unseen(StatefulProcessor):
    """Lets the first row of each key pass; the keys of an older log are seen from the start."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at boolean")

    def handleInitialState(self, key, rows, timer_values) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        first = next((r for r in rows if len(r)), None)
        if first is not None and not self.seen.exists():
            self.seen.update((True,))
            yield first.head(1)

    def close(self) -> None:
        pass


def keep_state(spark: SparkSession) -> None:
    """Arbitrary state needs the RocksDB store; the session's setting for new queries is changed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def write_new(stream: DataFrame, log: str, checkpoint: str, key: str) -> StreamingQuery:
    """Append rows whose key the log doesn't have yet, without reading the log again.

    Keys are state, so a micro-batch costs what it brings. The log is read once, where a checkpoint is new. Each micro-batch has a folder of its own
    in the log and replaces it when it is run again, so nothing is added twice.
    """
    spark = stream.sparkSession
    keep_state(spark)
    known = tables.completed(spark, log, key, dict(stream.dtypes)[key]).groupBy(key)
    new = stream.where(F.col(key).isNotNull()).groupBy(key).transformWithStateInPandas(Unseen(), stream.schema, "Append", "None", initialState=known)
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{log}/run={run}/batch={number}")

    return new.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
