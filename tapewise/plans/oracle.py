"""SQL building blocks: the same derived tables for the reference results in plain SQL."""

from __future__ import annotations

from tapewise.schemas import FEATURES, INDICATOR_COLUMNS, SENTIMENT_COLUMNS


def r(expr: str, digits: int) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits})"


def rx(expr: str, digits: int) -> str:
    """Round half up on the printed decimal value; for values that can be exact ties."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def mean4(total: str, n: str) -> str:
    return f"round_even({div(total, n)}, 0) / 10000e0"


_LABEL_COLUMNS = ", ".join(FEATURES)

_CTES: dict[str, tuple[list[str], str]] = {
    "trades": ([], """
        SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS px, l_quantity,
               {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey, 'e': l_extendedprice} AS k
        FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "bars": (["trades"], """
        SELECT ticker, date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close,
               CAST(sum(l_quantity) AS BIGINT) AS volume
        FROM trades GROUP BY ticker, date"""),
    "num": (["bars"], """
        SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n_rows,
               lag(close) OVER w AS prev
        FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)"""),
    "tr": (["num"], """
        SELECT *, greatest(high - low, coalesce(abs(high - prev), 0e0), coalesce(abs(low - prev), 0e0)) AS true_range,
               greatest(close - prev, 0e0) AS gain, greatest(prev - close, 0e0) AS loss FROM num"""),
    "rec": (["tr"], """
        SELECT ticker, pos, close AS e12, close AS e20, close AS e26, true_range AS a14,
               CAST(0 AS DOUBLE) AS g, CAST(0 AS DOUBLE) AS l, CAST(0 AS DOUBLE) AS sig
        FROM tr WHERE pos = 0
        UNION ALL
        SELECT s.ticker, s.pos, s.e12, s.e20, s.e26, s.a14, s.g, s.l, 0.2e0 * (s.e12 - s.e26) + 0.8e0 * s.sig
        FROM (SELECT t.ticker, t.pos,
                     2e0/13 * t.close + 11e0/13 * q.e12 AS e12, 2e0/21 * t.close + 19e0/21 * q.e20 AS e20,
                     2e0/27 * t.close + 25e0/27 * q.e26 AS e26, 2e0/15 * t.true_range + 13e0/15 * q.a14 AS a14,
                     CASE WHEN t.pos = 1 THEN t.gain ELSE t.gain/14 + 13e0/14 * q.g END AS g,
                     CASE WHEN t.pos = 1 THEN t.loss ELSE t.loss/14 + 13e0/14 * q.l END AS l, q.sig
              FROM rec q JOIN tr t ON t.ticker = q.ticker AND t.pos = q.pos + 1) s"""),
    "ind": (["tr", "rec"], f"""
        SELECT *, macd - macd_signal AS macd_hist, {div('bb_upper - bb_lower', 'bb_middle')} AS bb_width,
               {div('close - bb_lower', 'bb_upper - bb_lower')} AS bb_pct,
               CASE WHEN rsi > 70 THEN -1 WHEN rsi < 30 THEN 1 ELSE 0 END AS rsi_signal,
               {r(div('atr', 'close') + ' * 100', 3)} AS atr_pct
        FROM (SELECT *, bb_middle + 2 * sd AS bb_upper, bb_middle - 2 * sd AS bb_lower
              FROM (SELECT t.*, e12, e20 AS ema_20, e26, e12 - e26 AS macd, sig AS macd_signal,
                     {r('a14', 2)} AS atr,
                     CASE WHEN t.pos >= 14 THEN 100 - 100 / (1 + g / (l + 1e-10)) END AS rsi,
                     CASE WHEN t.pos >= 19 THEN avg(close) OVER w20 END AS sma_20,
                     CASE WHEN t.pos >= 49 THEN avg(close) OVER w50 END AS sma_50,
                     CASE WHEN t.pos >= 19 THEN avg(close) OVER w20 END AS bb_middle,
                     CASE WHEN t.pos >= 19 THEN stddev_samp(close) OVER w20 END AS sd,
                     CASE WHEN t.pos >= 19 THEN {div('volume', 'avg(volume) OVER w20')} END AS volume_ratio
              FROM tr t JOIN rec USING (ticker, pos)
              WINDOW w20 AS (PARTITION BY ticker ORDER BY t.date ROWS 19 PRECEDING),
                     w50 AS (PARTITION BY ticker ORDER BY t.date ROWS 49 PRECEDING)) a) b"""),
    "feat": (["ind"], f"""
        SELECT ticker, date, {rx('close', 2)} AS close, volume,
               {', '.join(f'{r(c, 6)} AS {c}' for c in INDICATOR_COLUMNS)}, rsi_signal, atr, atr_pct
        FROM ind WHERE pos >= 49 AND bb_pct IS NOT NULL AND volume_ratio IS NOT NULL"""),
    "derived": (["feat"], f"""
        SELECT *, {div('close', 'sma_20')} - 1 AS price_vs_sma20, {div('close', 'sma_50')} - 1 AS price_vs_sma50,
               (rsi - 50) / 50 AS rsi_normalized FROM feat"""),
    "labelled": (["derived"], f"""
        SELECT *, CASE WHEN {div('future - close', 'close')} > 0 THEN 1 ELSE 0 END AS label
        FROM (SELECT *, lead(close, 10) OVER (PARTITION BY ticker ORDER BY date) AS future FROM derived) q
        WHERE future IS NOT NULL"""),
    "dataset": (["labelled"], f"""
        SELECT ticker, date, close, {_LABEL_COLUMNS}, label FROM labelled
        WHERE {' AND '.join(f'{c} IS NOT NULL' for c in FEATURES)}"""),
    "placed": (["dataset"], """
        SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos,
               count(*) OVER (PARTITION BY ticker) AS n_rows FROM dataset"""),
    "scores": (["dataset"], """
        SELECT ticker, date, 1 - rsi/100 AS prob, label AS actual,
               CASE WHEN 1 - rsi/100 > 0.5e0 THEN 1 ELSE 0 END AS pred FROM dataset"""),
    "metadata": ([], """
        SELECT p_brand AS ticker, 'Company ' || p_brand AS company_name, min(p_type) AS sector FROM part
        WHERE p_brand <> (SELECT min(p_brand) FROM part) GROUP BY p_brand"""),
    "tickers": ([], "SELECT DISTINCT p_brand AS ticker FROM part"),
    "news": ([], f"""
        SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) - CAST(day(l_shipdate) % 2 AS INTEGER) AS date, p_name AS headline,
               CASE WHEN l_linestatus = 'F' THEN p_type END AS description, l_linestatus AS source,
               {rx('(l_discount - l_tax) * 10', 4)} AS sentiment_score, l_orderkey, l_linenumber
        FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "units": (["news"], """
        SELECT *, CAST(round_even(sentiment_score * 10000, 0) AS BIGINT) AS u FROM news"""),
    "daily": (["units"], f"""
        SELECT ticker, date, {mean4('sum(u)', 'count(*)')} AS sentiment, CAST(count(*) AS INTEGER) AS article_count
        FROM units GROUP BY ticker, date"""),
    "aligned": (["bars", "daily"], """
        SELECT b.ticker, b.date, d.sentiment, d.article_count
        FROM bars b LEFT JOIN daily d ON b.ticker = d.ticker AND b.date = d.date"""),
    "filled": (["aligned"], """
        SELECT ticker, date, article_count, coalesce(
            last_value(sentiment IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
            first_value(sentiment IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date
                ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0e0) AS sentiment
        FROM aligned"""),
    "sentiment": (["filled"], f"""
        SELECT ticker, date, sentiment_1d, sentiment_3d, sentiment_7d,
               (round_even(sentiment_1d * 10000, 0) - round_even(sentiment_7d * 10000, 0)) / 10000e0
                   AS sentiment_momentum, coalesce(article_count, 0) AS article_count
        FROM (SELECT *, {mean4('sum(u) OVER w1', 'count(*) OVER w1')} AS sentiment_1d,
                     {mean4('sum(u) OVER w3', 'count(*) OVER w3')} AS sentiment_3d,
                     {mean4('sum(u) OVER w7', 'count(*) OVER w7')} AS sentiment_7d
              FROM (SELECT *, CAST(round_even(sentiment * 10000, 0) AS BIGINT) AS u FROM filled) f
              WINDOW w1 AS (PARTITION BY ticker ORDER BY date ROWS 0 PRECEDING),
                     w3 AS (PARTITION BY ticker ORDER BY date ROWS 2 PRECEDING),
                     w7 AS (PARTITION BY ticker ORDER BY date ROWS 6 PRECEDING)) q"""),
    "feat_sent": (["derived", "sentiment"], f"""
        SELECT d.*, {', '.join(f'coalesce(s.{c}, 0e0) AS {c}' for c in SENTIMENT_COLUMNS)}
        FROM derived d LEFT JOIN sentiment s ON d.ticker = s.ticker AND d.date = s.date"""),
    "regimes": (["num"], """
        SELECT ticker, date, CASE WHEN pos < 200 THEN 'unknown' WHEN close > m THEN 'bull' ELSE 'bear' END AS regime
        FROM (SELECT *, avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS 199 PRECEDING) AS m FROM num) q"""),
    "with_regime": (["scores", "regimes"], """
        SELECT s.ticker, s.date, s.prob, s.actual, s.pred, g.regime
        FROM scores s ASOF LEFT JOIN regimes g ON s.ticker = g.ticker AND s.date >= g.date"""),
    "windows": (["placed"], """
        SELECT *, blk - skipped AS win FROM (
            SELECT *, st + blk * 21 AS train_size,
                   greatest(0, CAST(ceil((150 - st) / 21e0) AS BIGINT)) AS skipped
            FROM (SELECT *, CAST(floor((pos - st) / 21e0) AS BIGINT) AS blk
                  FROM (SELECT *, CAST(floor(n_rows * 0.5e0) AS BIGINT) AS st FROM placed) a) b
            WHERE pos >= st) c WHERE train_size >= 150"""),
    "returns": (["scores", "bars"], f"""
        SELECT *, coalesce({div('price - lag(price) OVER w', 'lag(price) OVER w')}, 0e0) AS ret,
               lag(prob) OVER w AS prev_prob
        FROM (SELECT s.*, {rx('b.close', 2)} AS price FROM scores s LEFT JOIN bars b
              ON s.ticker = b.ticker AND s.date = b.date) q
        WINDOW w AS (PARTITION BY ticker ORDER BY date)"""),
}


def equity_ctes(thresholds: list[float], cost: float, source: str, dependencies: list[str]) -> dict:
    """Position, equity and drawdown per (ticker, threshold) over the CTE ``source``."""
    values = ", ".join(f"({t}e0)" for t in thresholds)
    return {
        "pos_rows": (dependencies, f"""
            SELECT *, position * ret - change * {cost}e0 AS sret FROM (
                SELECT *, abs(position - coalesce(CASE WHEN prev_prob > threshold THEN 1e0 WHEN prev_prob IS NOT NULL
                       THEN 0e0 END, position)) AS change
                FROM (SELECT s.*, t.threshold, CASE WHEN prob > t.threshold THEN 1e0 ELSE 0e0 END AS position
                      FROM {source} s, (VALUES {values}) t(threshold)) a) b"""),
        "cum": (["pos_rows"], """
            SELECT *, product(1 + sret) OVER w AS cum_strategy, product(1 + ret) OVER w AS cum_buyhold
            FROM pos_rows WINDOW w AS (PARTITION BY ticker, threshold ORDER BY date ROWS UNBOUNDED PRECEDING)"""),
        "equity": (["cum"], f"""
            SELECT *, {div('cum_strategy - running_max', 'running_max')} AS drawdown
            FROM (SELECT *, max(cum_strategy) OVER (PARTITION BY ticker, threshold ORDER BY date
                         ROWS UNBOUNDED PRECEDING) AS running_max FROM cum) q"""),
        "risk": (["equity"], f"""
            SELECT ticker, threshold, {r('cs - 1', 4)} AS total_return,
                   {r('CASE WHEN cs - 1 >= -1 THEN pow(1 + (cs - 1), 252e0 / days) - 1 END', 4)} AS annual_return,
                   {r('CASE WHEN sd > 0 THEN mu / sd * sqrt(252e0) ELSE 0e0 END', 3)} AS sharpe_ratio,
                   {r('dd', 4)} AS max_drawdown, {r('coalesce(' + div('wins', 'days_invested') + ', 0e0)', 4)} AS win_rate,
                   {r('CASE WHEN loss < 0 THEN coalesce(gain, 0e0) / abs(loss) ELSE 999e0 END', 3)} AS profit_factor,
                   n_trades, days_invested, {r('cb - 1', 4)} AS bh_total_return,
                   {r('CASE WHEN cb - 1 >= -1 THEN pow(1 + (cb - 1), 252e0 / days) - 1 END', 4)} AS bh_annual_return
            FROM (SELECT ticker, threshold, arg_max(cum_strategy, date) AS cs, arg_max(cum_buyhold, date) AS cb,
                         count(*) AS days, avg(sret) AS mu, stddev_pop(sret) AS sd, min(drawdown) AS dd,
                         CAST(sum(CASE WHEN position = 1 AND sret > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins,
                         CAST(sum(position) AS BIGINT) AS days_invested,
                         sum(CASE WHEN position = 1 AND sret > 0 THEN sret END) AS gain,
                         sum(CASE WHEN position = 1 AND sret < 0 THEN sret END) AS loss,
                         CAST(sum(change) AS BIGINT) AS n_trades
                  FROM equity GROUP BY ticker, threshold) q"""),
    }


def auc_ctes(source: str, keys: list[str], dependencies: list[str], name: str = "auc") -> dict:
    k = ", ".join(keys)
    return {
        f"{name}_counts": (dependencies, f"""
            SELECT {k}, prob, sum(CASE WHEN actual = 1 THEN 1 ELSE 0 END) AS p,
                   sum(CASE WHEN actual = 0 THEN 1 ELSE 0 END) AS q FROM {source} GROUP BY {k}, prob"""),
        name: ([f"{name}_counts"], f"""
            SELECT {k}, coalesce({div('sum(p * (below + q / 2e0))', 'sum(p) * sum(q)')}, 0.5e0) AS roc_auc
            FROM (SELECT *, coalesce(sum(q) OVER (PARTITION BY {k} ORDER BY prob
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {name}_counts) z
            GROUP BY {k}"""),
    }


def sql(select: str, *names: str, extra: dict | None = None) -> str:
    """``select`` with the CTEs ``names`` and everything they need."""
    known = {**_CTES, **(extra or {})}
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for d in known[name][0]:
                visit(d)
            order.append(name)

    for n in names:
        visit(n)
    if not order:
        return select
    body = ",\n".join(f"{n} AS ({known[n][1].strip()})" for n in order)
    return f"WITH RECURSIVE {body}\n{select.strip()}"
