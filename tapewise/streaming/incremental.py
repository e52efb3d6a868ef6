"""Incremental refresh of stored prices and indicators, batch or as an available-now stream."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewise.operators.averages import WHOLE
from tapewise.operators.indicators import ROLLING_ROWS, indicator_carry, indicators_all
from tapewise.operators.panel import unit_of, unit_states
from tapewise.operators.sentiment import daily_sentiment, score_range, sentiment_windows
from tapewise.operators.stats import latest_row
from tapewise.schemas import INDICATORS, PRICES, SENTIMENT
from tapewise.sources import staging
from tapewise.sources.ingest import trailing_period
from tapewise.sources.store import Ledger, PanelStore, indicator_rows, price_rows, sentiment_rows

#: Folders of the state table, by ticker.
SLOTS = 64
#: Up to so many tickers, their names go into the scan of the bars as a list.
LISTED = 256


def _state_columns() -> list[str]:
    return ["_start", *indicator_carry().columns]


def state_schema() -> T.StructType:
    """A row per ticker and quarter: its rows, and what counts of all rows before it."""
    key = T.StructType().add("ticker", T.StringType(), False).add("_unit", T.IntegerType(), False).add("_cnt", T.LongType())
    for c in _state_columns():
        key = key.add(c, T.LongType() if c.startswith((*WHOLE, "_start")) else T.DoubleType())
    return key


def first_day(unit: int) -> dt.date:
    """The first day of a quarter."""
    year, quarter = divmod(unit - 1, 4)
    return dt.date(max(year, 1), 3 * quarter + 1, 1)


class Refresher:
    """Keeps ``prices`` (unrounded bars are kept beside them) and ``indicators`` up to date, and a log of the loads.

    ``states`` has a row per ticker and quarter: how many rows the quarter has, and the state of all averages before
    it. A batch therefore reads the bars from a quarter on that is early enough for the rolling windows of
    its first changed row; older ones are in the state. Everything that is written can be written again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.bars = PanelStore(spark, f"{root}/bars", PRICES)
        self.prices = PanelStore(spark, f"{root}/prices", PRICES)
        self.indicators = PanelStore(spark, f"{root}/indicators", INDICATORS)
        self.states = PanelStore(spark, f"{root}/states", state_schema(), ["ticker", "_unit"], ("slot", F.pmod(F.xxhash64("ticker"), F.lit(SLOTS))))
        self.loads = Ledger(spark, f"{root}/loads")

    def apply(self, batch: DataFrame, batch_id: str | None = None) -> None:
        """Upsert a batch of bars and the indicators it changes, and log it. Safe to repeat; one id is logged once."""
        batch = batch.persist()  # read once per table below
        try:
            self.bars.upsert(batch)
            self.prices.upsert(price_rows(batch))
            self._recompute(batch.groupBy("ticker").agg(F.min("date").alias("since")))
            self.loads.record(batch_id or uuid.uuid4().hex, batch)
        finally:
            batch.unpersist()

    def refresh_tickers(self, tickers: DataFrame) -> None:
        """Recompute the whole history of the requested tickers only."""
        self._recompute(tickers.select("ticker").distinct().withColumn("since", F.lit("0001-01-01").cast("date")))

    def beginnings(self, changed: DataFrame) -> DataFrame:
        """ticker, since, _from (the quarter to read from) and the state before it, a row per row of ``changed``.

        The latest quarter with at least ROLLING_ROWS rows between its start and that of ``since``, or the first one.
        A ticker without earlier quarters begins with that of ``since`` and no state.
        """
        units = self.states.scan().join(changed, "ticker").filter(F.col("_unit") < unit_of("since"))
        later = Window.partitionBy("ticker").orderBy(F.desc("_unit")).rowsBetween(Window.unboundedPreceding, 0)
        units = units.withColumn("_rows", F.sum("_cnt").over(later))
        row = F.struct("_unit", *_state_columns())
        found = units.groupBy("ticker").agg(F.coalesce(F.max_by(row, F.when(F.col("_rows") >= ROLLING_ROWS, F.col("_unit"))), F.min_by(row, "_unit")).alias("_b"))
        return changed.join(found, "ticker", "left").select("ticker", "since", F.coalesce("_b._unit", unit_of("since")).alias("_from"),
                                                            *(F.col(f"_b.{c}").alias(c) for c in _state_columns()))

    def history(self, begin: DataFrame) -> DataFrame:
        """The bars of the tickers of ``beginnings`` from their quarters on; earlier months are not opened."""
        first = begin.agg(F.min("_from")).first()[0]
        names = [r["ticker"] for r in begin.select("ticker").limit(LISTED + 1).collect()]
        bars = self.bars.read(start=first_day(first).isoformat() if first is not None and first > 8 else None)
        if len(names) <= LISTED:
            bars = bars.filter(F.col("ticker").isin(names))
        return bars.join(begin.select("ticker", "_from", "since"), "ticker").filter(unit_of() >= F.col("_from")).drop("_from")

    def _recompute(self, changed: DataFrame) -> None:
        begin = staging.written(self.beginnings(changed), "beginnings")
        rows = self.history(begin)
        units = staging.written(unit_states(rows, indicator_carry(), begin), "units")
        touched = indicators_all(rows, units=units).filter(F.col("date") >= F.col("since"))
        # Written first: the merge looks at the batch twice, and it must not change under it.
        self.indicators.upsert(staging.written(indicator_rows(touched), "touched"))
        self.states.upsert(units)

    def run(self, feed: str, checkpoint: str, files_per_batch: int | None = None) -> None:
        """Apply the files of ``feed`` not seen before, then stop. The checkpoint makes re-runs free.

        A micro-batch that is repeated after a failure has the same id, so the log has it once.
        """
        reader = self.spark.readStream.schema(PRICES)
        if files_per_batch is not None:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        stream = reader.parquet(feed).select("*", F.struct(
            F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("path")).alias("_arrival"))
        name = checkpoint.rstrip("/").rsplit("/", 1)[-1]
        query = (stream.writeStream.foreachBatch(lambda batch, number: self.apply(newest(batch), f"{name}-{number}"))
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()


def newest(batch: DataFrame) -> DataFrame:
    """One row per key: the one of the file that arrived last. Only one row per key and task is shuffled."""
    rest = [c for c in PRICES.names if c not in ("ticker", "date")]
    one = batch.groupBy("ticker", "date").agg(F.max_by(F.struct(*rest), "_arrival").alias("_r"))
    return one.select("ticker", "date", "_r.*")


def daily_refresh(spark: SparkSession, bars: DataFrame, requested: DataFrame, years: int = 2,
                  root: str | None = None) -> DataFrame:
    """Trailing bars -> prices and indicators of all requested tickers in one job.

    Returns one row per requested ticker: whether it produced rows, and how many.
    """
    work = Refresher(spark, root or staging.new_path(spark, "refresh"))
    work.apply(trailing_period(bars.join(requested, "ticker", "left_semi"), years))
    counts = work.indicators.read().groupBy("ticker").agg(F.count(F.lit(1)).alias("indicator_rows"))
    prices = work.prices.read().groupBy("ticker").agg(F.count(F.lit(1)).alias("price_rows"))
    out = requested.join(prices, "ticker", "left").join(counts, "ticker", "left")
    return out.withColumns({
        "price_rows": F.coalesce("price_rows", F.lit(0)), "indicator_rows": F.coalesce("indicator_rows", F.lit(0)),
        "success": F.col("price_rows").isNotNull()})


def sentiment_refresh(spark: SparkSession, news: DataFrame, bars: DataFrame, requested: DataFrame,
                      root: str | None = None) -> DataFrame:
    """Scored news -> daily -> rolling -> stored sentiment; tickers without news are reported as failed."""
    # Aggregated before any join on ticker: a ticker with very many articles shrinks to one row a day.
    daily = daily_sentiment(news).join(requested, "ticker", "left_semi")
    ranges = score_range(news).join(requested, "ticker", "left_semi")
    with_news = bars.join(ranges.select("ticker"), "ticker", "left_semi")
    path = staging.new_path(spark, "sentiment-batch")
    sentiment_rows(sentiment_windows(with_news, daily)).write.parquet(path)
    store = PanelStore(spark, f"{root or staging.new_path(spark, 'sentiment')}/sentiment", SENTIMENT)
    store.upsert(spark.read.parquet(path))
    last = latest_row(store.read()).select("ticker", "sentiment_3d", "sentiment_momentum")
    out = requested.join(ranges, "ticker", "left").join(last, "ticker", "left")
    return out.withColumn("success", F.col("sentiment_3d").isNotNull())
