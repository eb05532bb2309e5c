"""Tables that change: rows upserted, deleted and got by id with merge on read, and a read-through cache of retrieval results."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder where the cluster keeps what all executors share (``spark.checkpoint.dir``); a local one only in a session of one process."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", place)
    return f"{place.rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class KeyedTable:
    """Rows by id at ``path``, in ``buckets`` folders by the id's hash.

    Every change only appends: rows, or tombstones, with the number of the change. Reading keeps each id's last change, so no file is rewritten until
    ``compact``, which replaces the buckets that hold more than one change and leaves the others' files alone. One writer at a time; a change that fails
    half-way is made again under the same number, and rows of equal id and number count once (the greatest by their hash).
    Null ids are left out.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id", buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.fields = schema
        self.stored = f"{schema}, _change long, _deleted boolean, bucket int"
        self.columns = spark.createDataFrame([], schema).columns

    def _bucket(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(F.col(key) if isinstance(key, str) else key), F.lit(self.buckets)).cast("int")

    def _changes(self) -> DataFrame:
        return _read(self.spark, self.path, self.stored)

    def _append(self, rows: DataFrame, deleted: bool) -> int:
        number = (self._changes().agg(F.max("_change")).first()[0] or 0) + 1
        marked = rows.where(F.col(self.key).isNotNull()).withColumns({"_change": F.lit(number).cast("long"), "_deleted": F.lit(deleted), "bucket": self._bucket(self.key)})
        marked.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.path)
        return number

    def upsert(self, rows: DataFrame) -> int:
        """Add rows or replace those of equal ids; the change's number."""
        return self._append(rows.select(*self.columns), False)

    def delete(self, ids: DataFrame) -> int:
        """Delete by id (a column of ``ids``); absent ids do no harm."""
        kinds = dict(self.spark.createDataFrame([], self.fields).dtypes)
        return self._append(ids.select(self.key).distinct().select(*(F.col(c) if c == self.key else F.lit(None).cast(kinds[c]).alias(c) for c in self.columns)), True)

    def _alive(self, changes: DataFrame) -> DataFrame:
        row = F.struct(*self.columns, "_change", "_deleted")
        last = changes.groupBy("bucket", self.key).agg(F.max_by(row, F.struct("_change", F.xxhash64(*self.columns))).alias("r"))
        return last.where("NOT r._deleted")

    def read(self) -> DataFrame:
        return self._alive(self._changes()).select(*(F.col("r")[c].alias(c) for c in self.columns))

    def get(self, ids: DataFrame) -> DataFrame:
        """The rows of the ids asked for, each once; only their buckets are read."""
        asked = ids.select(self.key).where(F.col(self.key).isNotNull()).distinct().withColumn("bucket", self._bucket(self.key))
        some = sorted(r["bucket"] for r in asked.select("bucket").distinct().collect())  # a number for each bucket at most
        changes = self._changes().where(F.col("bucket").isin(some)).join(asked, ["bucket", self.key], "left_semi")
        return self._alive(changes).select(*(F.col("r")[c].alias(c) for c in self.columns))

    def compact(self) -> int:
        """Rewrite the buckets that hold several changes, or tombstones beside other rows; how many. What is left of a bucket counts as its last change."""
        counts = self._changes().groupBy("bucket").agg(F.count_distinct("_change").alias("n"), F.max("_change").alias("last"), (F.bool_or("_deleted") & (F.count("*") > 1)).alias("d"))
        some = {r["bucket"]: r["last"] for r in counts.where("n > 1 OR d").collect()}  # a row for each bucket at most
        if some:
            changes = self._changes().where(F.col("bucket").isin(*some))
            alive = self._alive(changes)
            # a bucket of which nothing is left keeps one tombstone, so that it is replaced too
            gone = changes.where("_deleted").groupBy("bucket").agg(F.max_by(F.struct(*self.columns, "_change", "_deleted"), F.struct("_change", self.key)).alias("r"))
            left = alive.select("bucket", "r").unionByName(gone.join(alive.select("bucket").distinct(), "bucket", "left_anti"))
            last = F.element_at(F.create_map(*(F.lit(x) for pair in some.items() for x in pair)), F.col("bucket"))
            out = left.select(*(F.col("r")[c].alias(c) for c in self.columns), last.cast("long").alias("_change"), F.col("r._deleted").alias("_deleted"), "bucket")
            out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return len(some)


def digest_of(query: Column, kind: Column, settings: dict, version: str) -> Column:
    """The key of a cached result: it changes with the query, its type, any setting and the index version."""
    fixed = json.dumps([sorted(settings.items()), version], default=str)
    return F.sha2(F.to_json(F.struct(query.alias("q"), kind.alias("k"), F.lit(fixed).alias("s")), {"ignoreNullFields": "false"}), 256)


def cached(queries: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, result: str, settings: dict, version: str, query: str = "query", kind: str = "kind") -> DataFrame:
    """``queries`` (with ``query`` and ``kind`` columns) with ``results``, an array of structs ``result``; results once computed are read from the table at ``path``.

    ``compute`` gets the queries that the table lacks, each once, with ``key``, and gives (key, rank, and the columns of ``result``). A key's results are one row, appended when the
    job commits, so they are there whole or not at all; keys written twice by jobs side by side count once. A query without hits is kept as an empty array. The old
    versions' rows stay until the folder is dropped.
    """
    spark = queries.sparkSession
    names = spark.createDataFrame([], result).columns
    schema = f"key string, results array<struct<rank: int, {result.replace(' ', ': ', 1) if ',' not in result else ', '.join(c.strip().replace(' ', ': ', 1) for c in result.split(','))}>>"
    keyed = queries.withColumn("key", digest_of(F.col(query), F.col(kind), settings, version))
    missing = keyed.dropDuplicates(["key"]).join(_read(spark, path, schema).select("key"), "key", "left_anti")
    found = compute(missing).groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), *names))).alias("results"))
    none = F.array().cast(schema.split("results ")[1])
    missing.select("key").join(found, "key", "left").select("key", F.coalesce("results", none).alias("results")).write.mode("append").parquet(path)
    known = spark.read.schema(schema).parquet(path).groupBy("key").agg(F.any_value("results").alias("results"))
    return keyed.join(known, "key").drop("key")
