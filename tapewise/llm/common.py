"""Helpers shared by the operators: reading tables, whole texts, files in the shared folder."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python task turns into objects at a time; texts can be long.
SLICE_ROWS = 256
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Texts can be long, so the session's Arrow batches get at most BATCH_ROWS rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The whole text, empty for null."""
    return F.coalesce(F.col(column), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that driver and executors share, and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri.removeprefix('file:'))}")


def write_whole(uri: str, attempt: str, write) -> int:
    """``write(stream)`` into a file that appears whole or not at all; a task that runs again replaces its file."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    hidden = f"{os.path.dirname(path)}/.{os.path.basename(path)}.{attempt}"
    with fs.open_output_stream(hidden, compression=None) as stream:
        write(stream)
        size = stream.tell()
    if fs.get_file_info(path).type != pafs.FileType.NotFound:  # not every file system moves onto a file
        fs.delete_file(path)
    fs.move(hidden, path)
    return size


def attempt() -> tuple[int, str]:
    """The partition of the running task, and a name for its attempt."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId(), f"{context.taskAttemptId()}-{os.getpid()}"


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def probe_names(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the wanted columns; further ones of any name are left out before an operator adds its own."""
    return df.select(*wanted)
