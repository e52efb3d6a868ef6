"""Readers and cleaners for bars, news payloads and knowledge documents."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewise.operators.panel import units_all, with_carry
from tapewise.schemas import KNOWLEDGE, NEWS_PAYLOAD, RAW_BARS


def file_key(ticker: Column, period: str) -> Column:
    return F.concat(F.replace(ticker, F.lit("."), F.lit("_")), F.lit(f"_{period}"))


def write_bars(bars: DataFrame, path: str, period: str = "2y") -> None:
    """Raw bars as CSV, one folder per ticker (dots in the name become underscores)."""
    named = bars.select(
        "ticker", file_key(F.col("ticker"), period).alias("file"), F.col("date").cast("timestamp").alias("Date"),
        *[F.col(c.lower()).alias(c) for c in ("Open", "High", "Low", "Close", "Volume")])
    # A range exchange cuts a large ticker over several files instead of one task per folder.
    ordered = named.repartitionByRange("file", "Date").sortWithinPartitions("file", "Date").drop("ticker")
    ordered.write.partitionBy("file").option("header", True).mode("overwrite").csv(path)


def reload_csv(spark: SparkSession, path: str) -> DataFrame:
    """Saved bars with parsed dates; the ticker part of the folder name comes back as ``file_ticker``."""
    schema = T.StructType([*RAW_BARS.fields, T.StructField("file", T.StringType())])
    raw = spark.read.schema(schema).option("header", True).csv(path)
    return raw.withColumn("file_ticker", F.regexp_extract("file", r"^(.*)_[^_]+$", 1)).drop("file")


def _key_of(uri: str) -> str:
    """The key of a file: its folder's (``file=KEY/...``, escaped by Spark) or its own name (``KEY.csv``)."""
    folder, name = unquote(uri).rsplit("/", 2)[-2:]
    return unquote(folder.removeprefix("file=")) if folder.startswith("file=") else name.removesuffix(".csv")


def load_many(spark: SparkSession, requested: DataFrame, folder: str, period: str = "2y") -> tuple[DataFrame, DataFrame]:
    """Raw bars of all requested tickers whose files can be read, and a report of every requested ticker.

    Files lie in ``folder`` as ``write_bars`` leaves them or as ``KEY.csv``, with a header line each. The report has
    ticker, loaded, rows, broken (lines that do not parse) and reason: null, or why the file is not or not wholly loaded - missing, empty,
    wrong header, no rows, broken lines (the others of its lines are loaded). One bad file never stops the load.
    All files are read once, as lines; a large one is split like any text. Their names, which Spark's own file
    index holds on the driver as well, tell empty files, which no scan shows, from missing ones.
    """
    keyed = requested.select("ticker").distinct().withColumn("key", file_key(F.col("ticker"), period))
    lines = spark.read.text(folder)
    listed = spark.createDataFrame([(k, True) for k in sorted({_key_of(uri) for uri in lines.inputFiles()})], "key string, listed boolean")
    own = F.col("file") if "file" in lines.columns else F.regexp_extract(F.try_url_decode(F.col("_metadata.file_path")), r"([^/]+)\.csv$", 1)
    lines = lines.select(own.alias("key"), "value")
    header = F.lower(F.regexp_replace("value", r"[\s\ufeff]", "")) == ",".join(RAW_BARS.names).lower()
    kinds = T.StructType([*RAW_BARS.fields, T.StructField("_broken", T.StringType())]).simpleString().removeprefix("struct<").removesuffix(">")
    parsed = lines.withColumn("header", header).withColumn(
        "bar", F.from_csv("value", kinds.replace(":", " "), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    sound = F.col("bar._broken").isNull() & F.col("bar.Date").isNotNull()
    told = parsed.groupBy("key").agg(
        F.max("header").alias("headed"), F.count_if(~F.col("header") & sound).alias("rows"), F.count_if(~F.col("header") & ~sound).alias("broken"))
    report = keyed.join(listed, "key", "left").join(told, "key", "left")
    headed = F.coalesce("headed", F.lit(False))
    reason = (F.when(F.col("listed").isNull(), "missing").when(F.col("headed").isNull(), "empty").when(~headed, "wrong header")
              .when(F.col("rows") == 0, "no rows").when(F.col("broken") > 0, "broken lines"))
    report = report.select("ticker", (headed & (F.col("rows") > 0)).alias("loaded"), F.when(headed, F.col("rows")).otherwise(0).alias("rows"),
                           F.coalesce("broken", F.lit(0)).alias("broken"), reason.alias("reason"))
    good = keyed.join(told.filter("headed").select("key"), "key")
    bars = parsed.filter(~F.col("header") & sound).join(good, "key").select("ticker", *(F.col(f"bar.{c}").alias(c) for c in RAW_BARS.names))
    return bars, report


def ingest_bars(raw: DataFrame) -> DataFrame:
    """Five bar columns with a plain date; rows without a close are dropped."""
    return raw.select(
        "ticker", F.col("Date").cast("date").alias("date"),
        *[F.col(c).cast("double").alias(c.lower()) for c in ("Open", "High", "Low", "Close")],
        F.col("Volume").cast("long").alias("volume"),
    ).dropna(subset=["close"])


def require_rows(df: DataFrame, message: str = "no bars returned") -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def coverage(requested: DataFrame, loaded: DataFrame) -> DataFrame:
    """Requested tickers with a flag whether anything was loaded for them."""
    seen = loaded.select("ticker").distinct().withColumn("loaded", F.lit(True))
    return requested.select("ticker").join(seen, "ticker", "left").withColumn(
        "loaded", F.coalesce("loaded", F.lit(False)))


def trailing_period(bars: DataFrame, years: int = 1) -> DataFrame:
    """Bars of the last ``years`` years of each ticker."""
    rows = with_carry(bars, [F.max("date").alias("_d")], [{"_last": F.max("_d").over(units_all())}], ["_last"],
                      windowed=False)
    return rows.filter(F.col("date") > F.add_months("_last", -12 * years)).drop("_last", "_unit")


def read_news(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NEWS_PAYLOAD).json(path)


def ingest_news(payloads: DataFrame) -> DataFrame:
    """Articles of successful payloads: date (first ten characters), texts with null as empty."""
    articles = payloads.filter(F.col("status") == "ok").select("ticker", F.explode("articles").alias("a"))

    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    return articles.select(
        "ticker", F.to_date(F.substring("a.publishedAt", 1, 10)).alias("date"), text("a.title").alias("headline"),
        text("a.description").alias("description"), text("a.source.name").alias("source"))


def news_window(news: DataFrame, as_of: Column, days_back: int = 7, max_articles: int = 50,
                order: list[Column] | None = None) -> DataFrame:
    """Articles of the last ``days_back`` days, the ``max_articles`` newest per ticker.

    ``row_number() <= k`` lets every task keep only its own k newest rows before the exchange.
    """
    recent = news.filter((F.col("date") >= F.date_sub(as_of, days_back)) & (F.col("date") <= as_of))
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc(), *(order or []))
    return recent.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= max_articles).drop("_k")


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(KNOWLEDGE).json(path)


def documents_by_id(documents: DataFrame, *ids: object) -> DataFrame:
    return documents.filter(F.col("id").isin(*ids))


def topics(documents: DataFrame) -> DataFrame:
    """Document count and ids per topic. Ids of one topic are gathered in parts of about 1000."""
    part = F.floor(F.col("id") / 1000) if dict(documents.dtypes)["id"] in ("bigint", "int") \
        else F.pmod(F.xxhash64("id"), F.lit(documents.count() // 1000 + 1))
    return documents.groupBy("topic", part.cast("long").alias("part")).agg(
        F.count(F.lit(1)).alias("documents"), F.array_sort(F.collect_list("id")).alias("ids"))
