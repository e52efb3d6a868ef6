"""Keyed parquet tables with insert-or-update.

Tables are partitioned by calendar month. A daily batch touches one partition whatever the number of
tickers; rows are range-clustered by (ticker, date) inside, so a ticker filter prunes row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewise.schemas import INDICATOR_COLUMNS, LOADS, PRICE_COLUMNS, SENTIMENT_COLUMNS

KEY = ["ticker", "date"]


def _number(c: str, digits: int | None = None) -> Column:
    """Null instead of NaN, rounded when asked."""
    x = F.when(~F.isnan(F.col(c)), F.col(c))
    return (x if digits is None else F.round(x, digits)).alias(c)


def price_rows(bars: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Bars as stored: prices to 2 decimals, whole volumes."""
    return bars.select(*KEY, *[_number(c, 2) for c in PRICE_COLUMNS], F.col("volume").cast("long").alias("volume"), *(extra or []))


def indicator_rows(indicators: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Indicators as stored: 6 decimals, NaN as null."""
    return indicators.select(*KEY, *[_number(c, 6) for c in INDICATOR_COLUMNS], *(extra or []))


def sentiment_rows(features: DataFrame, extra: list[str] | None = None) -> DataFrame:
    count = "article_count" if "article_count" in features.columns else F.lit(None).cast("int").alias("article_count")
    return features.select(*KEY, *[_number(c) for c in SENTIMENT_COLUMNS], count, *(extra or []))


def last_of_each(batch: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """One row per key: the last by ``order`` and then by its values, so that the choice is definite.

    A grouped maximum, combined before the shuffle: a key that is repeated very often is no hot task.
    Columns that are only in ``order`` drop out.
    """
    keys = keys or KEY
    rest = [c for c in batch.columns if c not in keys and c not in (order or [])]
    by = F.struct(*(order or []), *rest)
    one = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_r"))
    return one.select(*keys, "_r.*")


def upsert(base: DataFrame, batch: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows of ``base`` not in ``batch`` plus one row of ``batch`` per key, its last (see ``last_of_each``).

    An anti join: the usual small batch is broadcast after its size is known and ``base`` stays in place.
    """
    keys = keys or KEY
    one = last_of_each(batch.select(*base.columns, *(order or [])), keys, order)
    return base.join(one.select(*keys), keys, "left_anti").unionByName(one.select(*base.columns))


def fetch_log(loads: DataFrame) -> DataFrame:
    """Last refresh time per ticker, of the rows of a ``Ledger``."""
    return loads.groupBy("ticker").agg(F.max("loaded_at").alias("last_fetched"))


def _month(day: Column) -> Column:
    return F.year(day) * 100 + F.month(day)


class PanelStore:
    """One keyed table on disk, in folders by month or by another whole number of its rows."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str] | None = None,
                 folder: tuple[str, Column] | None = None):
        self.spark, self.path, self.columns, self.keys = spark, path, schema.names, keys or KEY
        self.folder, self.number = folder or ("month", _month(F.col("date")))
        self.schema = T.StructType([*schema.fields, T.StructField(self.folder, T.IntegerType())])

    def exists(self) -> bool:
        context = self.spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(context._jsc.hadoopConfiguration()).exists(target)

    def scan(self) -> DataFrame:
        """All columns with that of the folders (``month``: yyyymm)."""
        if not self.exists():
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def read(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """Rows between two inclusive dates; months outside are not opened."""
        rows = self.scan()
        if start is not None:
            day = F.lit(start).cast("date")
            rows = rows.filter((F.col("date") >= day) & (F.col("month") >= _month(day)))
        if end is not None:
            day = F.lit(end).cast("date")
            rows = rows.filter((F.col("date") <= day) & (F.col("month") <= _month(day)))
        return rows.select(*self.columns)

    def upsert(self, batch: DataFrame) -> None:
        """Merge a batch, of which the last row per key counts. Only the folders it touches are read and replaced.

        The batch must not be derived from this table: replacing the files would change it. Folders are
        replaced one after the other; after a failure in between, the same batch applied again completes it.
        """
        rows = last_of_each(batch.select(*self.columns), self.keys).withColumn(self.folder, self.number.cast("int"))
        touched = [r[0] for r in rows.select(self.folder).distinct().collect()]  # bounded by the calendar, or by the number of folders
        if not touched:
            return
        merged = upsert(self.scan().filter(F.col(self.folder).isin(touched)), rows, self.keys) if self.exists() else rows
        clustered = merged.repartitionByRange(self.folder, *self.keys).sortWithinPartitions(self.folder, *self.keys)
        clustered.write.partitionBy(self.folder).option("partitionOverwriteMode", "dynamic") \
            .mode("overwrite").parquet(self.path)


class Ledger:
    """What was loaded when: a row per batch and ticker, written with the load.

    A batch has a folder of its own that a repeated load replaces, so a batch applied twice leaves its rows once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def record(self, batch_id: str, rows: DataFrame, loaded_at: Column | None = None) -> None:
        """Log the rows of a batch; ``loaded_at`` is an aggregate of a ticker's rows, the present time by default."""
        at = F.current_timestamp() if loaded_at is None else loaded_at
        entries = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
                                             at.alias("loaded_at"))
        entries.withColumn("batch", F.lit(batch_id)).write.partitionBy("batch").option("partitionOverwriteMode", "dynamic") \
            .mode("overwrite").parquet(self.path)

    def read(self) -> DataFrame:
        """ticker, rows, first_date, last_date, loaded_at and batch."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], LOADS)
        return self.spark.read.schema(LOADS).parquet(self.path)
