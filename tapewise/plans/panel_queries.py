"""Ingest, storage, indicator, feature and sentiment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewise.functions import scalar as S
from tapewise.operators import features as feat
from tapewise.operators import indicators as ind
from tapewise.operators import sentiment as sent
from tapewise.operators import signals as sig
from tapewise.operators import stats
from tapewise.plans.oracle import div, mean4, r, rx, sql
from tapewise.plans.registry import query, rounded
from tapewise.plans.tables import Tables
from tapewise.schemas import FEATURES, FEATURES_WITH_SENTIMENT, INDICATOR_COLUMNS, SENTIMENT_COLUMNS
from tapewise.sources import ingest, staging, store

PRICE_SCALE = ["sma_20", "sma_50", "ema_20", "macd", "macd_signal", "macd_hist", "bb_upper", "bb_lower"]


def rs(columns: list[str]) -> str:
    """Rounded select list: price-scaled columns to 4 decimals, others to 6."""
    return ", ".join(f"{rx(c, 4 if c in PRICE_SCALE else 6)} AS {c}" for c in columns)


def rd(df, columns: list[str]):
    return df.withColumns({c: F.round(c, 4 if c in PRICE_SCALE else 6) for c in columns})


# ---- sources and sinks ---------------------------------------------------------------------------------

_RAW = """(SELECT ticker, date, open, high, low,
           CASE WHEN high > low OR day(date) % 2 = 0 THEN close END AS close, volume FROM bars)"""


@query("ingest_bars", sql(f"SELECT * FROM {_RAW} q WHERE close IS NOT NULL", "bars"))
def _(t: Tables):
    return ingest.ingest_bars(t.raw_bars())


def _saved_csv(t: Tables) -> str:
    return staging.staged_path(t.spark, t.dir, "bars_csv", lambda path: ingest.write_bars(t.bars(), path))


@query("ingest_many", sql("""
    SELECT t.ticker, count(b.ticker) > 0 AS loaded FROM (
        SELECT ticker FROM tickers UNION ALL SELECT 'missing ' || ticker FROM metadata) t
    LEFT JOIN bars b ON t.ticker = b.ticker GROUP BY t.ticker""", "bars", "tickers", "metadata"))
def _(t: Tables):
    asked = t.tickers().unionByName(t.metadata().select(F.concat(F.lit("missing "), "ticker").alias("ticker")))
    return ingest.load_many(t.spark, asked, _saved_csv(t))[1].select("ticker", "loaded")


@query("reload_csv", sql("""
    SELECT replace(ticker, '.', '_') AS ticker, date, open, high, low, close, volume FROM bars""", "bars"))
def _(t: Tables):
    return ingest.ingest_bars(ingest.reload_csv(t.spark, _saved_csv(t)).withColumnRenamed("file_ticker", "ticker"))


@query("write_bars", sql("""
    SELECT replace(ticker, '.', '_') AS file_ticker, count(*) AS rows, CAST(min(date) AS TIMESTAMP) AS first,
           CAST(max(date) AS TIMESTAMP) AS last FROM bars GROUP BY ticker""", "bars"))
def _(t: Tables):
    saved = ingest.reload_csv(t.spark, _saved_csv(t))
    return saved.groupBy("file_ticker").agg(F.count(F.lit(1)).alias("rows"), F.min("Date").alias("first"),
                                            F.max("Date").alias("last"))


@query("trailing_period", sql("""
    SELECT ticker, date, open, high, low, close, volume
    FROM (SELECT *, max(date) OVER (PARTITION BY ticker) AS last FROM bars) q
    WHERE date > last - INTERVAL 12 MONTH""", "bars"))
def _(t: Tables):
    return ingest.trailing_period(t.bars(), 1)


def _batch_bars(t: Tables):
    """A corrected delivery of the last two years, prices up a tenth: every bar twice, then at doubled volume."""
    rows = ingest.trailing_period(t.bars(), 2).withColumns({c: F.col(c) * 1.1 for c in ("open", "high", "low", "close")})
    return _twice(rows, volume=F.col("volume") * 2)


def _twice(rows, **last):
    """The rows as they are and once more, numbered as arriving later, with other values."""
    first = rows.withColumn("arrival", F.lit(1))
    return first.unionByName(rows.withColumn("arrival", F.lit(2)).withColumns(last))


_IN_BATCH = "date > max(date) OVER (PARTITION BY ticker) - INTERVAL 24 MONTH"


@query("upsert_prices", sql(f"""
    SELECT ticker, date, {', '.join(f"{rx(f'CASE WHEN b THEN {c} * 1.1e0 ELSE {c} END', 2)} AS {c}"
                                     for c in ('open', 'high', 'low', 'close'))},
           CASE WHEN b THEN volume * 2 ELSE volume END AS volume
    FROM (SELECT *, {_IN_BATCH} AS b FROM bars) q""", "bars"))
def _(t: Tables):
    batch = store.price_rows(_batch_bars(t), extra=["arrival"])
    return store.upsert(store.price_rows(t.bars()), batch, order=["arrival"])


@query("upsert_indicators", sql(f"""
    SELECT ticker, date, {', '.join(f"CASE WHEN b THEN NULL ELSE {rx(r(c, 6), 4 if c in PRICE_SCALE else 6)} END AS {c}"
                                     if c == 'rsi' else f"{rx(r(c, 6), 4 if c in PRICE_SCALE else 6)} AS {c}"
                                     for c in INDICATOR_COLUMNS)}
    FROM (SELECT *, {_IN_BATCH} AS b FROM ind WHERE pos >= 49) q""", "ind"))
def _(t: Tables):
    base = store.indicator_rows(t.indicators())
    fresh = _twice(ingest.trailing_period(t.indicators(), 2), rsi=F.lit(float("nan")))
    return rd(store.upsert(base, store.indicator_rows(fresh, extra=["arrival"]), order=["arrival"]), INDICATOR_COLUMNS)


@query("upsert_sentiment", sql(f"""
    SELECT ticker, date, CASE WHEN b THEN NULL ELSE sentiment_1d END AS sentiment_1d, sentiment_3d, sentiment_7d,
           sentiment_momentum, article_count FROM (SELECT *, {_IN_BATCH} AS b FROM sentiment) q""", "sentiment"))
def _(t: Tables):
    rows = store.sentiment_rows(t.sentiment())
    fresh = _twice(ingest.trailing_period(rows, 2), sentiment_1d=F.lit(float("nan")))
    return store.upsert(rows, store.sentiment_rows(fresh, extra=["arrival"]), order=["arrival"])


@query("fetch_log", sql("""
    SELECT ticker, CAST(max(date) AS TIMESTAMP) AS last_fetched FROM bars GROUP BY ticker""", "bars"))
def _(t: Tables):
    def load(path: str) -> None:
        """Three loads, of which one is repeated; a ticker's newest bar stands for the time of its load."""
        log = store.Ledger(t.spark, path)
        for part in (0, 1, 2, 1):
            log.record(f"load {part}", t.bars().filter(F.year("date") % 3 == part), F.max("date").cast("timestamp"))

    return store.fetch_log(store.Ledger(t.spark, staging.staged_path(t.spark, t.dir, "loads", load)).read())


@query("ingest_news", sql("""
    SELECT ticker, date, headline, coalesce(description, '') AS description,
           CASE WHEN l_linenumber = 3 THEN '' ELSE source END AS source
    FROM news WHERE l_linenumber <> 7""", "news"))
def _(t: Tables):
    return ingest.ingest_news(t.payloads())


@query("news_window", sql("""
    SELECT ticker, date, headline, description, source, sentiment_score FROM (
        SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC, headline, description NULLS FIRST,
               source, sentiment_score) AS k
        FROM news WHERE date >= (SELECT max(date) FROM news) - INTERVAL 60 DAY) q
    WHERE k <= 50""", "news"))
def _(t: Tables):
    news = t.news()
    today = F.lit(news.agg(F.max("date")).first()[0])  # "today" of the feed, a literal the scan can use
    order = [F.col("headline"), F.col("description").asc_nulls_first(), F.col("source"), F.col("sentiment_score")]
    return ingest.news_window(news, today, days_back=60, max_articles=50, order=order)


@query("ticker_query_map", sql("""
    SELECT t.ticker, coalesce(m.company_name, t.ticker) AS query
    FROM tickers t LEFT JOIN metadata m ON t.ticker = m.ticker""", "tickers", "metadata"))
def _(t: Tables):
    return sig.ticker_query(t.tickers(), t.metadata().select("ticker", F.col("company_name").alias("query")))


@query("kb_load", """
    SELECT lang AS topic, doc_id // 1000 AS part, count(*) AS documents, list(doc_id ORDER BY doc_id) AS ids
    FROM documents GROUP BY lang, doc_id // 1000""")
def _(t: Tables):
    return ingest.topics(t.knowledge())


_ASKED = "(SELECT ticker FROM tickers UNION ALL SELECT 'missing ' || ticker FROM metadata)"


_DAILY = sql(f"""
    SELECT t.ticker, count(r.ticker) AS price_rows, CAST(greatest(count(r.ticker) - 49, 0) AS BIGINT) AS indicator_rows,
           count(r.ticker) > 0 AS success
    FROM {_ASKED} t LEFT JOIN (SELECT ticker FROM (SELECT *, max(date) OVER (PARTITION BY ticker) AS last FROM bars) q
                               WHERE date > last - INTERVAL 24 MONTH) r ON r.ticker = t.ticker
    GROUP BY t.ticker""", "bars", "tickers", "metadata")


@query("run_pipeline", _DAILY)
@query("daily_refresh", _DAILY)
def _(t: Tables):
    from tapewise.streaming.incremental import daily_refresh
    asked = t.tickers().unionByName(t.metadata().select(F.concat(F.lit("missing "), "ticker").alias("ticker")))
    return daily_refresh(t.spark, t.bars(), asked, years=2)


_SENTIMENT = sql(f"""
    SELECT t.ticker, n.min_score, n.max_score, s.sentiment_3d, s.sentiment_momentum, s.sentiment_3d IS NOT NULL AS success
    FROM {_ASKED} t
    LEFT JOIN (SELECT ticker, min(sentiment_score) AS min_score, max(sentiment_score) AS max_score FROM news GROUP BY ticker) n
           ON n.ticker = t.ticker
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM sentiment) s
           ON s.ticker = t.ticker AND s.k = 1 AND n.ticker IS NOT NULL""", "news", "sentiment", "tickers", "metadata")


@query("run_sentiment_pipeline", _SENTIMENT)
@query("sentiment_refresh", _SENTIMENT)
def _(t: Tables):
    from tapewise.streaming.incremental import sentiment_refresh
    asked = t.tickers().unionByName(t.metadata().select(F.concat(F.lit("missing "), "ticker").alias("ticker")))
    return sentiment_refresh(t.spark, t.news(), t.bars(), asked)


_STORED = f"SELECT ticker, date, {', '.join(f'{rx(r(c, 6), 4 if c in PRICE_SCALE else 5)} AS {c}' for c in INDICATOR_COLUMNS)} FROM ind"


@query("incremental_update", sql(f"{_STORED} WHERE pos >= 49", "ind"))
def _(t: Tables):
    from tapewise.streaming.incremental import Refresher
    feed = staging.new_path(t.spark, "feed")
    t.bars().withColumn("year", F.year("date")).repartition("year").drop("year").write.parquet(feed)
    work = Refresher(t.spark, staging.new_path(t.spark, "incremental"))
    work.run(feed, staging.new_path(t.spark, "incremental-checkpoint"), files_per_batch=3)
    return _shown(work.indicators.read())


def _shown(stored):
    return stored.withColumns({c: F.round(c, 4 if c in PRICE_SCALE else 5) for c in INDICATOR_COLUMNS})


@query("refresh_ticker", sql(f"{_STORED} WHERE pos >= 49 AND ticker IN (SELECT ticker FROM metadata)", "ind", "metadata"))
def _(t: Tables):
    from tapewise.streaming.incremental import Refresher
    work = Refresher(t.spark, staging.new_path(t.spark, "refresh"))
    work.bars.upsert(t.bars())
    work.refresh_tickers(t.metadata())
    return _shown(work.indicators.read())


# ---- projections and filters ---------------------------------------------------------------------------


@query("price_range", sql("""
    SELECT * FROM bars WHERE ticker = (SELECT max(ticker) FROM tickers)
    AND date >= DATE '1995-01-01' AND date <= DATE '2000-12-31'""", "bars", "tickers"))
def _(t: Tables):
    name = t.tickers().agg(F.max("ticker")).first()[0]
    return sig.price_range(t.bars(), name, "1995-01-01", "2000-12-31")


@query("watchlist", sql("""
    SELECT upper(ticker) AS ticker, date, close FROM feat
    WHERE upper(ticker) IN (SELECT upper(ticker) FROM metadata)""", "feat", "metadata"))
def _(t: Tables):
    return sig.watchlist(t.features().select("ticker", "date", "close"), t.metadata())


@query("ticker_search", sql("""
    SELECT ticker, company_name FROM metadata
    WHERE contains(lower(ticker), 'd#1') OR contains(lower(company_name), 'd#1')""", "metadata"))
def _(t: Tables):
    return sig.ticker_search(t.metadata().select("ticker", "company_name"), "D#1")


@query("price_chart", sql(f"""
    SELECT ticker, date AS day, strftime(date, '%d %b') AS date, {r('close', 2)} AS price,
           {r('sma_20', 2)} AS sma20, {r('sma_50', 2)} AS sma50, volume
    FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM feat) q
    WHERE k <= 90""", "feat"))
def _(t: Tables):
    return sig.price_chart(t.features(), 90)


@query("derived_features", sql(f"""
    SELECT ticker, date, {rs(['price_vs_sma20', 'price_vs_sma50', 'rsi_normalized'])} FROM derived""", "derived"))
def _(t: Tables):
    cols = ["price_vs_sma20", "price_vs_sma50", "rsi_normalized"]
    return rd(feat.derived_features(t.features()), cols).select("ticker", "date", *cols)


@query("drop_incomplete", sql("""
    SELECT ticker, date, close FROM num
    WHERE pos >= 49""", "num"))
def _(t: Tables):
    every = ind.indicators_all(t.bars(), complete_only=False)
    return feat.drop_incomplete(every, INDICATOR_COLUMNS).select("ticker", "date", "close")


def _history(rows: int) -> str:
    return sql(f"""
    SELECT ticker, date, close FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS n FROM dataset) q
    WHERE n >= {rows}""", "dataset")


@query("min_history_gate", _history(100))
def _(t: Tables):
    return feat.min_history(t.dataset(), 100).select("ticker", "date", "close")


@query("min_history_gate_long", _history(1600))
def _(t: Tables):
    return feat.min_history(t.dataset(), 1600).select("ticker", "date", "close")


# ---- joins ---------------------------------------------------------------------------------------------


@query("features", sql(f"""
    SELECT ticker, date, close, volume, {rs(INDICATOR_COLUMNS)} FROM feat""", "feat"))
def _(t: Tables):
    return rd(feat.features(store.price_rows(t.bars()), store.indicator_rows(t.indicators())), INDICATOR_COLUMNS)


@query("features_sentiment", sql(f"""
    SELECT ticker, date, close, {rs(INDICATOR_COLUMNS)}, {', '.join(SENTIMENT_COLUMNS)} FROM feat_sent""", "feat_sent"))
def _(t: Tables):
    rows = feat.features_sentiment(store.price_rows(t.bars()), store.indicator_rows(t.indicators()),
                                   store.sentiment_rows(t.sentiment()))
    return rd(rows, INDICATOR_COLUMNS)


@query("company_name", sql("""
    SELECT t.ticker, coalesce(m.company_name, t.ticker) AS company_name
    FROM tickers t LEFT JOIN metadata m ON t.ticker = m.ticker""", "tickers", "metadata"))
def _(t: Tables):
    return sig.company_name(t.tickers(), t.metadata())


@query("calendar_align", sql("SELECT * FROM aligned", "aligned"))
def _(t: Tables):
    return sent.calendar_align(t.bars(), sent.daily_sentiment(t.news()))


# ---- window functions ----------------------------------------------------------------------------------


@query("daily_return", sql(f"""
    SELECT ticker, date, {r(div('close - prev', 'prev') + ' * 100', 6)} AS daily_return FROM num""", "num"))
def _(t: Tables):
    return rounded(ind.daily_return(t.bars()), 6, "daily_return").select("ticker", "date", "daily_return")


@query("return_direction", sql("""
    SELECT ticker, date, CASE WHEN close > prev THEN 'up' ELSE 'down' END AS direction FROM num""", "num"))
def _(t: Tables):
    return ind.daily_return(t.bars()).select("ticker", "date", "direction")


@query("normalised_base100", sql(f"""
    SELECT ticker, date, {r(div('close', 'first_value(close) OVER (PARTITION BY ticker ORDER BY date)') + ' * 100', 6)}
           AS normalised FROM bars""", "bars"))
def _(t: Tables):
    return rounded(stats.normalised_base100(t.bars()), 6, "normalised").select("ticker", "date", "normalised")


@query("sma", sql(f"""
    SELECT ticker, date, {rx('CASE WHEN pos >= 19 THEN avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING) END', 4)}
           AS sma_20 FROM num""", "num"))
def _(t: Tables):
    return rd(ind.sma(t.bars(), 20), ["sma_20"]).select("ticker", "date", "sma_20")


@query("ema", sql(f"SELECT ticker, date, {rx('e20', 4)} AS ema_20 FROM tr JOIN rec USING (ticker, pos)", "tr", "rec"))
def _(t: Tables):
    return rd(ind.ema(t.bars(), 20), ["ema_20"]).select("ticker", "date", "ema_20")


@query("moving_averages", sql(f"SELECT ticker, date, {rs(['sma_20', 'sma_50', 'ema_20'])} FROM ind", "ind"))
def _(t: Tables):
    cols = ["sma_20", "sma_50", "ema_20"]
    return rd(ind.moving_averages(t.bars()), cols).select("ticker", "date", *cols)


@query("sma_crossover", sql("""
    SELECT ticker, date, ma_position, ma_position - lag(ma_position) OVER (PARTITION BY ticker ORDER BY date) AS ma_signal
    FROM (SELECT *, CASE WHEN sma_20 > sma_50 THEN 1 ELSE -1 END AS ma_position FROM ind) q""", "ind"))
def _(t: Tables):
    return ind.sma_crossover(t.bars()).select("ticker", "date", "ma_position", "ma_signal")


@query("rsi", sql("SELECT ticker, date, round(rsi, 6) AS rsi FROM ind", "ind"))
def _(t: Tables):
    return rounded(ind.rsi(t.bars()), 6, "rsi").select("ticker", "date", "rsi")


@query("rsi_signal", sql("SELECT ticker, date, rsi_signal FROM ind", "ind"))
def _(t: Tables):
    return ind.rsi(t.bars()).select("ticker", "date", ind.rsi_signal(F.col("rsi")).alias("rsi_signal"))


@query("macd", sql(f"SELECT ticker, date, {rs(['macd', 'macd_signal', 'macd_hist'])} FROM ind", "ind"))
def _(t: Tables):
    cols = ["macd", "macd_signal", "macd_hist"]
    return rd(ind.macd(t.bars()), cols).select("ticker", "date", *cols)


@query("macd_crossover", sql("""
    SELECT ticker, date, above - lag(above) OVER (PARTITION BY ticker ORDER BY date) AS macd_cross
    FROM (SELECT *, CASE WHEN macd > macd_signal THEN 1 ELSE 0 END AS above FROM ind) q""", "ind"))
def _(t: Tables):
    return ind.macd_crossover(t.bars()).select("ticker", "date", "macd_cross")


@query("bollinger", sql(f"SELECT ticker, date, {r('bb_middle', 4)} AS bb_middle, {rs(['bb_upper', 'bb_lower', 'bb_width', 'bb_pct'])} FROM ind", "ind"))
def _(t: Tables):
    cols = ["bb_upper", "bb_lower", "bb_width", "bb_pct"]
    return rounded(rd(ind.bollinger(t.bars()), cols), 4, "bb_middle").select("ticker", "date", "bb_middle", *cols)


@query("true_range", sql("SELECT ticker, date, round(true_range, 6) AS true_range FROM (SELECT ticker, date, true_range + 1e-9 AS true_range FROM tr) q", "tr"))
def _(t: Tables):
    rows = ind.true_range(t.bars()).withColumn("true_range", F.col("true_range") + 1e-9)
    return rounded(rows, 6, "true_range").select("ticker", "date", "true_range")


@query("atr", sql("SELECT ticker, date, atr, atr_pct FROM ind WHERE pos > 0", "ind"))
def _(t: Tables):
    first = ind.atr(t.bars())
    return first.filter("pos > 0").select("ticker", "date", "atr", "atr_pct")


@query("volume_ratio", sql("SELECT ticker, date, round(volume_ratio, 6) AS volume_ratio FROM ind", "ind"))
def _(t: Tables):
    return rounded(ind.volume_ratio(t.bars()), 6, "volume_ratio").select("ticker", "date", "volume_ratio")


@query("indicators_all", sql(f"""
    SELECT ticker, date, open, high, low, close, volume, {rs(INDICATOR_COLUMNS)}, rsi_signal, atr, atr_pct
    FROM ind WHERE pos >= 49""", "ind"))
def _(t: Tables):
    return rd(ind.indicators_all(t.bars()), INDICATOR_COLUMNS)


@query("forward_label", sql("SELECT ticker, date, label FROM labelled", "labelled"))
def _(t: Tables):
    return feat.forward_label(t.features(), 10).select("ticker", "date", "label")


@query("dataset", sql(f"SELECT ticker, date, close, {rs(FEATURES)}, label FROM dataset", "dataset"))
def _(t: Tables):
    return rd(feat.dataset(t.features()), FEATURES)


@query("dataset_sentiment", sql(f"""
    SELECT ticker, date, close, {rs(FEATURES)}, {', '.join(SENTIMENT_COLUMNS)}, label FROM (
        SELECT *, CASE WHEN {div('future - close', 'close')} > 0 THEN 1 ELSE 0 END AS label
        FROM (SELECT *, lead(close, 10) OVER (PARTITION BY ticker ORDER BY date) AS future FROM feat_sent) q
        WHERE future IS NOT NULL) z""", "feat_sent"))
def _(t: Tables):
    return rd(feat.dataset(t.features_sentiment(), columns=FEATURES_WITH_SENTIMENT), FEATURES)


@query("ffill_bfill", sql("SELECT ticker, date, sentiment FROM filled", "filled"))
def _(t: Tables):
    aligned = sent.calendar_align(t.bars(), sent.daily_sentiment(t.news()))
    return sent.ffill_bfill(aligned).select("ticker", "date", "sentiment")


@query("sentiment_windows", sql(f"SELECT ticker, date, {', '.join(SENTIMENT_COLUMNS)}, article_count FROM sentiment", "sentiment"))
def _(t: Tables):
    return sent.sentiment_windows(t.bars(), sent.daily_sentiment(t.news())).select(
        "ticker", "date", *SENTIMENT_COLUMNS, "article_count")


@query("daily_sentiment_mean", sql("SELECT ticker, date, sentiment FROM daily", "daily"))
def _(t: Tables):
    return sent.daily_sentiment(t.news()).select("ticker", "date", "sentiment")


@query("daily_sentiment_weighted", sql(f"""
    SELECT ticker, date, {mean4('sum(u * abs(u))', 'sum(abs(u))')} AS sentiment FROM units GROUP BY ticker, date""", "units"))
def _(t: Tables):
    return sent.daily_sentiment(t.news(), "weighted").select("ticker", "date", "sentiment")


@query("article_count", sql("SELECT ticker, date, article_count FROM daily", "daily"))
def _(t: Tables):
    return sent.daily_sentiment(t.news()).select("ticker", "date", "article_count")


@query("score_range", sql("SELECT ticker, min(sentiment_score) AS min_score, max(sentiment_score) AS max_score FROM news GROUP BY ticker", "news"))
def _(t: Tables):
    return sent.score_range(t.news())


@query("sentiment_coverage", sql("""
    SELECT ticker, CAST(sum(CASE WHEN sentiment_1d <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS days_with_news, count(*) AS days,
           round(avg(CASE WHEN sentiment_1d <> 0 THEN 1e0 ELSE 0e0 END), 6) AS coverage
    FROM feat_sent GROUP BY ticker""", "feat_sent"))
def _(t: Tables):
    return rounded(sent.sentiment_coverage(t.features_sentiment()), 6, "coverage")


@query("sentiment_label", sql("""
    SELECT ticker, date, sentiment_score, CASE WHEN sentiment_score > 0.3e0 THEN 'STRONGLY POSITIVE'
        WHEN sentiment_score > 0.1e0 THEN 'MILDLY POSITIVE' WHEN sentiment_score > -0.1e0 THEN 'NEUTRAL'
        WHEN sentiment_score > -0.3e0 THEN 'MILDLY NEGATIVE' ELSE 'STRONGLY NEGATIVE' END AS sentiment_label
    FROM news""", "news"))
def _(t: Tables):
    return t.news().select("ticker", "date", "sentiment_score", S.sentiment_label(F.col("sentiment_score")).alias("sentiment_label"))


@query("latest_sentiment", sql("""
    SELECT ticker, date, sentiment_1d, sentiment_3d, sentiment_7d, sentiment_momentum, article_count,
        CASE WHEN sentiment_3d > 0.3e0 THEN 'STRONGLY POSITIVE' WHEN sentiment_3d > 0.1e0 THEN 'MILDLY POSITIVE'
             WHEN sentiment_3d > -0.1e0 THEN 'NEUTRAL' WHEN sentiment_3d > -0.3e0 THEN 'MILDLY NEGATIVE'
             ELSE 'STRONGLY NEGATIVE' END AS sentiment_label
    FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM sentiment) q
    WHERE k = 1""", "sentiment"))
def _(t: Tables):
    return sent.latest_sentiment(t.sentiment())


@query("headline_text", sql("""
    SELECT ticker, date, CASE WHEN trim(coalesce(description, '')) NOT IN ('', 'nan')
        THEN trim(headline) || '. ' || trim(description) ELSE trim(headline) END AS text FROM news""", "news"))
def _(t: Tables):
    return t.news().select("ticker", "date", S.headline_text(F.col("headline"), F.col("description")).alias("text"))


