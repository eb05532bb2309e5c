"""Scans and sinks: ledger Parquet, JSON lines with the last record of a key, append-only result logs, keyed upserts."""

from __future__ import annotations

import io
import warnings
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factledger.schema import LEDGER


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger, or an empty one where there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def write_ledger(ledger: DataFrame, path: str) -> None:
    ledger.write.mode("overwrite").parquet(path)


def read_json_lines(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """Records of JSON-lines files; malformed lines go. With a key the last record of each key stays, by file and place."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if key is None:
        return rows
    placed = rows.withColumns({"_file": F.input_file_name(), "_at": F.monotonically_increasing_id()})
    last = Window.partitionBy(key).orderBy(F.desc("_file"), F.desc("_at"))
    return placed.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_file", "_at", "_n")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def completed(spark: SparkSession, path: str, key: str, kind: str = "long") -> DataFrame:
    """Keys of an append-only log; none where the log doesn't exist."""
    try:
        return spark.read.schema(f"{key} {kind}").json(path).select(key).where(F.col(key).isNotNull()).distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{key} {kind}")


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done, key, "left_anti")


def write_splits(rows: DataFrame, path: str) -> None:
    """One folder of JSON lines for each split."""
    rows.write.mode("overwrite").partitionBy("split").json(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows with those of equal keys replaced."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def read_routed(spark: SparkSession, path: str, schema: str, pools: dict[str, str]) -> DataFrame:
    """All JSON-lines files of a folder with ``pool`` by label (any case) and ``file``; other labels and malformed lines go."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.jsonl").json(path)
    names = F.create_map(*(F.lit(x) for pair in pools.items() for x in pair))
    routed = rows.withColumns({"pool": F.try_element_at(names, F.lower(F.trim("label"))), "file": F.element_at(F.split(F.input_file_name(), "/"), -1)})
    return routed.where("pool IS NOT NULL")


def read_checkpoint(spark: SparkSession, path: str, row: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of a checkpoint log of chunks: the ids that are done, their accepted rows (``row`` is their schema), and proposed and
    accepted counts of text chunks. Lines without an id, a count or rows are passed over."""
    lines = spark.read.schema(f"chunk_id string, block_type string, proposed_count long, accepted_rows array<struct<{row}>>").json(path)
    whole = lines.where("chunk_id IS NOT NULL AND proposed_count IS NOT NULL AND accepted_rows IS NOT NULL")
    text = F.coalesce("block_type", F.lit("TEXT")) == "TEXT"
    total = lambda c: F.coalesce(F.sum(F.when(text, c)), F.lit(0))
    counts = whole.agg(total(F.col("proposed_count")).alias("proposed"), total(F.size("accepted_rows").cast("long")).alias("accepted"))
    return whole.select("chunk_id").distinct(), whole.select(F.inline("accepted_rows")), counts


def read_csv_parts(spark: SparkSession, parts: dict[str, str], schema: str | None = None) -> DataFrame:
    """CSV files with headers (quoted fields may hold line ends), each with its kind in ``doc_type``."""
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    frames = [(read.schema(schema) if schema else read).csv(path).withColumn("doc_type", F.lit(kind)) for kind, path in parts.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Elements of JSON arrays, one array a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_pages(spark: SparkSession, path: str, question: str) -> DataFrame:
    """A row for each question of nested pages: its table (rows of cells), its paragraphs in order, and the question's fields."""
    schema = f"table struct<uid: string, table: array<array<string>>>, paragraphs array<struct<uid: string, order: int, text: string>>, questions array<struct<{question}>>"
    texts = F.transform(F.array_sort(F.transform("paragraphs", lambda p: F.struct(p["order"], p["text"]))), lambda p: p["text"])
    return read_json_array(spark, path, schema).select(F.col("table.table").alias("table"), texts.alias("paragraphs"), F.inline("questions"))


def read_zipped_json(spark: SparkSession, path: str, schema: str, members: str = ".json") -> DataFrame:
    """Elements of JSON arrays in zip archives, with the ``member`` they come from. A task holds one archive's members, one after the other."""

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b["content"].to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in sorted(n for n in archive.namelist() if n.endswith(members)):
                        yield pa.RecordBatch.from_pydict({"member": [name], "json": [archive.read(name).decode()]}, pa.schema([("member", pa.string()), ("json", pa.string())]))

    files = spark.read.format("binaryFile").load(path).select("content").mapInArrow(unzip, "member string, json string")
    return files.select("member", F.inline(F.from_json("json", f"array<struct<{schema}>>")))


def _settings(config: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in config.items() for x in pair))


def write_envelope(results: DataFrame, config: dict[str, str], path: str) -> None:
    """JSON lines ``{"_config": ..., "results": [...]}``: every result with the settings it was made with."""
    results.select(_settings(config).alias("_config"), F.array(F.struct("*")).alias("results")).write.mode("overwrite").json(path)


def read_envelope(spark: SparkSession, path: str, schema: str, config: dict[str, str], retry: Column | None = None, lines: bool = False) -> DataFrame:
    """Results of envelopes, one a file or one a line; those that ``retry`` marks are left out, to be made again.

    Warns where results were made with other settings, or none.
    """
    envelopes = spark.read.schema(f"_config map<string, string>, results array<struct<{schema}>>").option("multiLine", not lines).json(path)
    entries = lambda m: F.array_sort(F.map_entries(m))
    if envelopes.where(F.coalesce(entries(F.col("_config")) != entries(_settings(config)), F.lit(True))).limit(1).count():
        warnings.warn(f"results in {path} were made with other settings", stacklevel=2)
    rows = envelopes.select(F.inline("results"))
    return rows if retry is None else rows.where(~F.coalesce(retry, F.lit(False)))


def link_rows(chunks: DataFrame, ledger: DataFrame) -> DataFrame:
    """``chunks`` (chunk_id) with ``row_ids``, the ledger rows that came from each, sorted; empty where there are none."""
    linked = ledger.groupBy(F.col("source_chunk_id").alias("chunk_id")).agg(F.array_sort(F.collect_set("row_id")).alias("row_ids"))
    return chunks.drop("row_ids").join(linked, "chunk_id", "left").withColumn("row_ids", F.coalesce("row_ids", F.array().cast("array<string>")))


def shaped(lines: DataFrame, shapes: dict[str, dict[str, tuple[str, str]]], value: str = "value") -> DataFrame:
    """``lines`` of JSON records of several shapes as rows: ``shape``, and all shapes' columns, null where a shape lacks one.

    ``shapes`` gives for each shape its columns as (path, type). A record has the first shape of which it has every path with a value of that type; one of no shape,
    and a line that is no JSON, keeps a null ``shape``, so that bad rows can be counted. Each line is parsed once, whatever it is.
    """
    parsed = lines.withColumn("_v", F.try_parse_json(F.col(value)))
    read = {(shape, name): F.try_variant_get("_v", path, kind) for shape, fields in shapes.items() for name, (path, kind) in fields.items()}
    whole = {shape: reduce(Column.__and__, (read[shape, name].isNotNull() for name in fields)) for shape, fields in shapes.items()}
    parsed = parsed.withColumn("shape", F.coalesce(*(F.when(w, shape) for shape, w in whole.items())))
    names = list(dict.fromkeys(name for _, name in read))
    columns = [F.coalesce(*(F.when(F.col("shape") == shape, c) for (shape, n), c in read.items() if n == name)).alias(name) for name in names]
    return parsed.select(*lines.columns, "shape", *columns)


def read_object(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key, value for each field of the JSON objects in files, one object a file; ``value`` is the fields' type. Of a field that a file has twice the parser's choice stays."""
    return spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("key", "value"))


def write_object(rows: DataFrame, key: str, value: str, path: str) -> None:
    """One JSON object in one file from (key, value), keys in order: a side-file, so it is gathered in one task; large tables are JSON lines."""
    fields = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))))
    rows.where(F.col(key).isNotNull()).agg(fields.alias("value")).coalesce(1).write.mode("overwrite").text(path)
