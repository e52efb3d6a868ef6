"""Texts around predictions: ranked contributions, explanations, prompts and parsed replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewise.functions import scalar as S
from tapewise.operators.panel import numbered
from tapewise.schemas import EXPLANATIONS
from tapewise.sources.store import last_of_each


def contribution_array(names: list[str], values: list[Column], parts: list[Column]) -> Column:
    """array<struct<feature, value, shap_value, direction, magnitude>> in feature order."""
    def one(name: str, value: Column, part: Column) -> Column:
        return F.struct(F.lit(name).alias("feature"), F.round(value, 4).alias("value"),
                        F.round(part, 4).alias("shap_value"),
                        F.when(part > 0, "bullish").otherwise("bearish").alias("direction"),
                        F.round(F.abs(part), 4).alias("magnitude"))

    return F.array(*[one(n, v, p) for n, v, p in zip(names, values, parts)])


def top_features(contributions: Column, n: int = 5) -> Column:
    """The n largest by magnitude; equal magnitudes keep feature order. Bounded by the feature count."""
    placed = F.transform(contributions, lambda c, i: F.struct((-c["magnitude"]).alias("m"), i.alias("i"), c.alias("c")))
    return F.transform(F.slice(F.array_sort(placed), 1, n), lambda p: p["c"])


def feature_importance(rows: DataFrame) -> DataFrame:
    """Mean size of the contribution per feature, largest first."""
    long = rows.select(F.explode("contributions").alias("c")).select("c.feature", "c.shap_value")
    return long.groupBy("feature").agg(F.avg(F.abs("shap_value")).alias("importance")).orderBy(
        F.desc("importance"), "feature")


def most_bullish(rows: DataFrame) -> DataFrame:
    """The row with the largest sum of contributions (earliest key on ties), by partial aggregation."""
    total = F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c["shap_value"])
    ranked = rows.withColumn("total", F.round(total, 4))
    best = F.min_by(F.struct("ticker", "date", "total"), F.struct(-F.col("total"), "ticker", "date"))
    return ranked.agg(best.alias("_b")).select("_b.*")


def template_explanations(predictions: DataFrame) -> DataFrame:
    first = F.get("top_features", F.lit(0))
    return predictions.withColumn("explanation", S.template_explanation(
        F.col("company_name"), F.col("prob_up"), F.col("confidence"), first["feature"], first["direction"]))


def explanations_merge(predictions: DataFrame, replies: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Generated text by (ticker, date), the template where there is none; of several replies the last by ``order``."""
    base = template_explanations(predictions).withColumnRenamed("explanation", "_template")
    one = last_of_each(replies.select("ticker", "date", "explanation", *(order or [])), order=order)
    joined = base.join(one.withColumnRenamed("explanation", "_reply"), ["ticker", "date"], "left")
    return joined.withColumn("explanation", F.coalesce("_reply", "_template")).drop("_reply", "_template")


def _signal_lines(with_strength: bool) -> Column:
    def line(c: Column) -> Column:
        label, text = S.feature_label(c["feature"]), S.feature_description(c["feature"])
        strength = F.concat(S.signal_strength(c["magnitude"]), F.lit(" ")) if with_strength else F.lit("")
        return F.concat(F.lit("- "), label, F.lit(": "), strength, c["direction"], F.lit(" (measures "), text, F.lit(")"))

    return F.concat_ws("\n", F.transform(F.slice("top_features", 1, 5), line))


def explanation_prompts(predictions: DataFrame, horizon: int = 10) -> DataFrame:
    """One prompt per prediction from its five strongest signals."""
    prompt = F.concat(
        F.lit("Explain a model's forecast to a new investor: friendly, honest, under 150 words, no advice to buy "
              "or sell, every technical term explained.\n\nForecast for "), "company_name", F.lit(" ("), "ticker",
        F.lit(") as of "), F.date_format("date", "MMMM dd, yyyy"), F.lit(f":\n- chance of a rise within {horizon} "
        "trading days: "), S.percent1(F.col("prob_up")), F.lit("%\n- chance of a fall: "),
        S.percent1(1 - F.col("prob_up")), F.lit("%\n- confidence: "), F.upper("confidence"),
        F.lit("\n\nStrongest signals first:\n"), _signal_lines(True),
        F.lit("\n\nStart with the overall picture, explain two or three signals, name conflicting ones and "
              "close with the reminder that this is a probability."))
    return predictions.select("ticker", "date", prompt.alias("prompt"))


def portfolio_prompts(predictions: DataFrame, per_prompt: int = 50) -> DataFrame:
    """Prompts asking for a JSON array, each over at most ``per_prompt`` predictions of one ticker.

    Batches are numbered from 0 in date order within the ticker, by the panel's bounded row numbers.
    """
    entry = F.struct("ticker", "date", F.concat(
        F.lit("Ticker: "), "ticker", F.lit("\nDate: "), F.date_format("date", "yyyy-MM-dd"), F.lit("\nCompany: "), "company_name", F.lit("\nProbability up: "),
        S.percent1(F.col("prob_up")), F.lit("%\nProbability down: "), S.percent1(1 - F.col("prob_up")),
        F.lit("%\nConfidence: "), "confidence", F.lit("\nSignals:\n"), _signal_lines(False)).alias("text"))
    rows = numbered(predictions).select("ticker", F.floor(F.col("pos") / per_prompt).alias("batch"), entry.alias("e"))
    grouped = rows.groupBy("ticker", "batch").agg(F.array_sort(F.collect_list("e")).alias("es"), F.count(F.lit(1)).alias("n"))
    prompt = F.concat(
        F.lit('Explain each forecast below to a new investor in under 120 words, with its uncertainty and no '
              'advice. Reply only with JSON: [{"ticker": "...", "date": "yyyy-mm-dd", "explanation": "..."}]\n\n'),
        F.concat_ws("\n\n", F.transform("es", lambda e: e["text"])))
    return grouped.select("ticker", "batch", "n", prompt.alias("prompt"))


def parse_explanations(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Rows (ticker, date, explanation) of a JSON reply, with or without a code fence; none when it is broken."""
    text = F.regexp_replace(F.col(column), r"^\s+|\s+$", "")
    text = F.regexp_replace(F.regexp_replace(text, r"^```json", ""), r"```$", "")
    rest = [c for c in replies.columns if c != column]
    parsed = replies.select(*rest, F.from_json(text, EXPLANATIONS).alias("_all"))
    # One incomplete item makes the whole reply unusable.
    whole = F.forall("_all", lambda e: e["ticker"].isNotNull() & e["date"].isNotNull() & e["explanation"].isNotNull())
    items = parsed.filter(whole).select(*rest, F.explode("_all").alias("_e"))
    return items.select(*rest, "_e.ticker", "_e.date", "_e.explanation")
