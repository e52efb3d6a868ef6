"""The derived tables queries start from: bars, news, features, dataset, scores of one data folder.

The stored ones are written once per application (see ``sources.staging``) like the tables of a real
deployment, so that a query reads columns of a file instead of deriving bars again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewise.operators import explain, features as feat, indicators as ind, models, sentiment as sent
from tapewise.functions.fixed_values import HORIZONS
from tapewise.functions.scalar import confidence_bucket
from tapewise.operators.signals import company_name
from tapewise.schemas import EXTRA_INDICATOR_COLUMNS, FEATURES, FEATURES_WITH_SENTIMENT, INDICATOR_COLUMNS, NEWS_PAYLOAD
from tapewise.sources import fixtures, staging

SCORE_PARTS = ["rsi_normalized", "bb_pct", "price_vs_sma20", "price_vs_sma50", "bb_width", "volume_ratio"]


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.dir, name)

    def _stage(self, name: str, build) -> DataFrame:
        return staging.staged(self.spark, self.dir, name, build)

    def bars(self) -> DataFrame:
        return self._stage("bars", lambda: fixtures.bars(self.spark, self.dir))

    def raw_bars(self) -> DataFrame:
        """Bars as they arrive: title-case names, a timestamp, and no close where high = low on an odd day."""
        return self.bars().select("ticker", F.col("date").cast("timestamp").alias("Date"), F.col("open").alias("Open"),
                                  F.col("high").alias("High"), F.col("low").alias("Low"),
                                  F.when((F.col("high") > F.col("low")) | (F.dayofmonth("date") % 2 == 0),
                                         F.col("close")).alias("Close"),
                                  F.col("volume").cast("double").alias("Volume"))

    def indicators(self) -> DataFrame:
        return self._stage("indicators", lambda: ind.indicators_all(self.bars()))

    def features(self) -> DataFrame:
        """Stored prices and indicators of complete rows, with ATR and RSI signal."""
        return self.indicators().select(
            "ticker", "date", F.round("close", 2).alias("close"), "volume",
            *[F.round(c, 6).alias(c) for c in INDICATOR_COLUMNS], *EXTRA_INDICATOR_COLUMNS)

    def dataset(self) -> DataFrame:
        return self._stage("dataset", lambda: feat.dataset(self.features()))

    def labelled(self) -> DataFrame:
        """Complete feature rows with a label per horizon."""
        return self._stage("labelled", lambda: feat.drop_incomplete(
            feat.derived_features(feat.forward_labels(self.features(), HORIZONS)), FEATURES))

    def placed(self, name: str) -> DataFrame:
        """A dataset with the rank of each date and the first test day (``cut``) of the 80/20 split."""
        def build() -> DataFrame:
            rows = models.date_positions(getattr(self, name)())
            return rows.withColumn("cut", feat.train_rows(F.col("days")))

        return self._stage(f"{name}_placed", build)

    def scores(self) -> DataFrame:
        """Deterministic stand-in for model output."""
        prob = 1 - F.col("rsi") / 100
        return self.dataset().select("ticker", "date", prob.alias("prob"), F.col("label").alias("actual"),
                                     (prob > 0.5).cast("int").alias("pred"))

    def predictions(self) -> DataFrame:
        """Scores with company name, confidence and ranked contributions of six features."""
        d = self.dataset()
        values = [F.col(c) for c in SCORE_PARTS]
        parts: list[Column] = [-F.col("rsi_normalized"), 0.5 - F.col("bb_pct"), -F.col("price_vs_sma20"),
                               -F.col("price_vs_sma50"), F.col("bb_width") - 1, (F.col("volume_ratio") - 1) / 10]
        prob = F.round(1 - F.col("rsi") / 100, 4)
        rows = d.select("ticker", "date", prob.alias("prob_up"), confidence_bucket(prob).alias("confidence"),
                        explain.contribution_array(SCORE_PARTS, values, parts).alias("contributions"))
        rows = rows.withColumn("top_features", explain.top_features(F.col("contributions")))
        return company_name(rows, self.metadata())

    def metadata(self) -> DataFrame:
        """One row per brand but the first, which has to fall back to its ticker."""
        brands = self.raw("part").groupBy(F.col("p_brand").alias("ticker")).agg(F.min("p_type").alias("sector"))
        first = brands.agg(F.min("ticker").alias("ticker"))
        return brands.join(first, "ticker", "left_anti").select(
            "ticker", F.concat(F.lit("Company "), "ticker").alias("company_name"), "sector")

    def tickers(self) -> DataFrame:
        return self.raw("part").select(F.col("p_brand").alias("ticker")).distinct()

    def news_rows(self) -> DataFrame:
        """Every line item is an article; those of odd days appear on the day before, so odd days have no news."""
        part = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"),
                                       "p_name", "p_type")
        return self.raw("lineitem").join(part, "l_partkey").withColumn("published", F.date_sub(
            F.col("l_shipdate").cast("date"), F.dayofmonth(F.col("l_shipdate").cast("date")) % 2))

    def news(self) -> DataFrame:
        return self.news_rows().select(
            "ticker", F.col("published").alias("date"),
            F.col("p_name").alias("headline"), F.when(F.col("l_linestatus") == "F", F.col("p_type")).alias("description"),
            F.col("l_linestatus").alias("source"),
            F.round((F.col("l_discount") - F.col("l_tax")) * 10, 4).alias("sentiment_score"))

    def payloads(self) -> DataFrame:
        """News as JSON payloads of the news source, written and read back."""
        def build() -> DataFrame:
            article = F.struct(
                F.struct(F.lit(None).cast("string").alias("id"),
                         F.when(F.col("l_linenumber") != 3, F.col("l_linestatus")).alias("name")).alias("source"),
                F.col("p_name").alias("title"),
                F.when(F.col("l_linestatus") == "F", F.col("p_type")).alias("description"),
                F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"))
            status = F.when(F.col("l_linenumber") == 7, "error").otherwise("ok")
            rows = self.news_rows().select("ticker", status.alias("status"), F.array(article).alias("articles"))
            return rows.select(F.to_json(F.struct("ticker", "status", "articles")).alias("value"))

        stored = self._stage("payloads", build)
        return stored.select(F.from_json("value", NEWS_PAYLOAD).alias("p")).select("p.*")

    def sentiment(self) -> DataFrame:
        return self._stage("sentiment", lambda: sent.sentiment_windows(self.bars(), sent.daily_sentiment(self.news())))

    def features_sentiment(self) -> DataFrame:
        """Features joined with stored sentiment."""
        rows = self.features()
        return feat.features_sentiment(rows, rows, self.sentiment())

    def dataset_sentiment(self) -> DataFrame:
        return self._stage("dataset_sentiment",
                           lambda: feat.dataset(self.features_sentiment(), columns=FEATURES_WITH_SENTIMENT))

    def knowledge(self) -> DataFrame:
        return self.raw("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("topic"),
                                            F.col("source").alias("title"), F.col("text").alias("content"))

    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"),
                                             F.col("label").alias("topic"))

    def vector_queries(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))

    def vector_texts(self) -> DataFrame:
        """Title and text of a vector: the document of the same number."""
        return self.raw("documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("title"), "text")

    def questions(self) -> DataFrame:
        rows = self.raw("conversations").filter("role = 'user'")
        return rows.select(F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("query_id"), "text")
