"""Written intermediate tables in the folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: dict[tuple[str, str, str], str] = {}
_local_folders: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local_folders:
            _local_folders[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        folder = _local_folders[app]
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tapewise-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What the tables made and run in here shuffle is dropped when they end, for results that are written or collected once."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a cut of its lineage that survives executors.

    Used where an operator passes twice over the result of another two-pass operator, which would
    otherwise be computed once more per pass.
    """
    path = new_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_path(spark: SparkSession, source: str, name: str, write: Callable[[str], None]) -> str:
    """Where the data ``name`` derived from ``source`` lies; ``write(path)`` runs once per application."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _written:
        path = new_path(spark, name)
        write(path)
        _written[key] = path
    return _written[key]


def staged(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` derived from ``source``, written once per application and then read back.

    Cuts lineage and recomputation: operators that need a second pass over a panel (to count its rows
    per quarter, say) read columns of a file instead of repeating the work above it.
    """
    return spark.read.parquet(staged_path(spark, source, name, lambda path: build().write.parquet(path)))
