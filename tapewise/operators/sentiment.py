"""News sentiment: daily aggregates, calendar alignment, fills and rolling windows.

Scores carry four decimals, so all sums run on whole ten-thousandths and do not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewise.functions.scalar import mean4, sentiment_label, ten_thousandths
from tapewise.operators.panel import in_unit, units_before, with_carry, with_halo
from tapewise.operators.stats import latest_row
from tapewise.sources.staging import written

KEY = ["ticker", "date"]


def daily_sentiment(news: DataFrame, method: str = "mean") -> DataFrame:
    """Score per ticker and day ("mean", or "weighted" by the size of the score) and article count."""
    s = ten_thousandths(F.col("sentiment_score"))
    if method == "mean":
        score = mean4(F.sum(s), F.count("sentiment_score"))
    elif method == "weighted":
        score = mean4(F.sum(s * F.abs(s)), F.sum(F.abs(s)))
    else:
        raise ValueError(f"unknown aggregation method: {method}")
    return news.groupBy(*KEY).agg(score.alias("sentiment"), F.count(F.lit(1)).cast("int").alias("article_count"))


def score_range(news: DataFrame) -> DataFrame:
    return news.groupBy("ticker").agg(F.min("sentiment_score").alias("min_score"),
                                      F.max("sentiment_score").alias("max_score"))


def calendar_align(calendar: DataFrame, daily: DataFrame) -> DataFrame:
    """Daily sentiment on the trading days of the calendar; scores of other days disappear."""
    return calendar.select(*KEY).join(daily, KEY, "left")


def ffill_bfill(df: DataFrame, column: str = "sentiment", backfill: bool = True) -> DataFrame:
    """Carry the last value forward, fill the head with the first value, then with 0.

    The back-fill uses a later value for the head; ``backfill=False`` puts 0 there instead.
    """
    known = F.when(F.col(column).isNotNull(), F.col("date"))
    ends = [F.max_by(column, known).alias("_l"), F.min_by(column, known).alias("_f")]
    everything = Window.partitionBy("ticker").orderBy("_unit").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    rows = with_carry(df, ends, [{
        "_prev": F.last("_l", ignorenulls=True).over(units_before()),
        "_first": F.first("_f", ignorenulls=True).over(everything),
    }], ["_prev", "_first"])
    here = F.last(column, ignorenulls=True).over(in_unit().rowsBetween(Window.unboundedPreceding, 0))
    fills = [here, F.col("_prev")] + ([F.col("_first")] if backfill else []) + [F.lit(0.0)]
    return rows.withColumn(column, F.coalesce(*fills)).drop("_prev", "_first", "_unit")


def sentiment_windows(calendar: DataFrame, daily: DataFrame, windows: tuple[int, ...] = (1, 3, 7),
                      backfill: bool = True) -> DataFrame:
    """Rolling means over the last 1/3/7 trading days (at least one) and their momentum."""
    aligned = written(ffill_bfill(calendar_align(calendar, daily), backfill=backfill), "sentiment-aligned")
    h = with_halo(aligned, back=max(windows))
    h = h.add({"_s": ten_thousandths(F.col("sentiment"))})
    h = h.add({f"sentiment_{n}d": mean4(F.sum("_s").over(h.last(n)), F.count("_s").over(h.last(n)))
               for n in windows})
    short, long = (ten_thousandths(F.col(f"sentiment_{n}d")) for n in (windows[0], windows[-1]))
    h = h.add({"sentiment_momentum": (short - long) / 10000,
               "article_count": F.coalesce("article_count", F.lit(0))})
    return h.done("_s", "sentiment", "pos", "n_rows")


def sentiment_coverage(features: DataFrame) -> DataFrame:
    some = F.when(F.col("sentiment_1d") != 0, 1).otherwise(0)
    return features.groupBy("ticker").agg(F.sum(some).alias("days_with_news"), F.count(F.lit(1)).alias("days"),
                                          F.avg(some).alias("coverage"))


def latest_sentiment(sentiment: DataFrame) -> DataFrame:
    last = latest_row(sentiment)
    return last.withColumn("sentiment_label", sentiment_label(F.coalesce("sentiment_3d", F.lit(0.0))))
