"""What the operators share: table access, lineage cuts and Arrow batch bounds."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; whatever else the table carries is pruned at the scan."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder that all executors share, as the cluster names it.

    Where none is named, a local one serves a session in one process; on a cluster that would lose rows, so it is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", place)
    return f"{place.rstrip('/')}/{spark.sparkContext.applicationId}"


def fresh(frame: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``frame`` has no such column (names are compared without case)."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def cut(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back: later stages start from the files."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound what a Python worker holds at once; texts may be long, so rows are few."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds) over uint64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
