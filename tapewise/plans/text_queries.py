"""Explanation, prompt, knowledge and retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewise.functions import scalar as S
from tapewise.functions.fixed_values import FEATURE_DESCRIPTIONS, FEATURE_LABELS
from tapewise.operators import explain, retrieval, text_score
from tapewise.plans.oracle import rx, sql
from tapewise.plans.registry import query, rounded
from tapewise.plans.tables import SCORE_PARTS, Tables
from tapewise.sources import staging

# ---- predictions with contributions, in SQL ------------------------------------------------------------

_PARTS = ["-rsi_normalized", "0.5e0 - bb_pct", "-price_vs_sma20", "-price_vs_sma50", "bb_width - 1", "(volume_ratio - 1) / 10"]
_CONF = """CASE WHEN abs({p} - 0.5e0) > 0.2e0 THEN 'high' WHEN abs({p} - 0.5e0) > 0.1e0 THEN 'medium' ELSE 'low' END"""
_LABELS = ", ".join("('{}', '{}', '{}')".format(k, v.replace("'", "''"), FEATURE_DESCRIPTIONS.get(k, k).replace("'", "''"))
                    for k, v in FEATURE_LABELS.items())
_PRED = {
    "preds": (["dataset", "metadata"], f"""
        SELECT d.*, {rx('1 - rsi/100', 4)} AS prob_up, coalesce(m.company_name, d.ticker) AS company_name
        FROM dataset d LEFT JOIN metadata m ON d.ticker = m.ticker"""),
    "parts": (["preds"], " UNION ALL ".join(f"""
        SELECT ticker, date, company_name, prob_up, {i} AS i, '{f}' AS feature, {rx(f, 4)} AS value, {rx(p, 4)} AS shap_value,
               CASE WHEN {p} > 0 THEN 'bullish' ELSE 'bearish' END AS direction, {rx(f'abs({p})', 4)} AS magnitude FROM preds"""
        for i, (f, p) in enumerate(zip(SCORE_PARTS, _PARTS)))),
    "ranked": (["parts"], """
        SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY magnitude DESC, i) AS k FROM parts"""),
    "labels_of": ([], f"SELECT * FROM (VALUES {_LABELS}) t(feature, label, description)"),
}


def _pct(p: str) -> str:
    return f"CAST(CAST(round(CAST(CAST({p} * 100e0 AS VARCHAR) AS DECIMAL(38,18)), 1) AS DECIMAL(38,1)) AS VARCHAR)"


_TEMPLATE = f"""company_name || ' shows a ' || {_pct('prob_up')} || '% probability of a price '
    || CASE WHEN prob_up > 0.5e0 THEN 'rise' ELSE 'fall' END || ' over the next 10 trading days. The strongest signal comes from the '
    || label || ', which is currently ' || direction || '. Model confidence is ' || {_CONF.format(p='prob_up')}
    || '. Remember: this is a probability estimate, not a guarantee.'"""
_EXPLAINED = f"SELECT ticker, date, {_TEMPLATE} AS explanation FROM ranked JOIN labels_of USING (feature) WHERE k = 1"


@query("confidence_bucket", sql(f"SELECT ticker, date, {_CONF.format(p='prob_up')} AS confidence FROM preds", "preds", extra=_PRED))
def _(t: Tables):
    return t.predictions().select("ticker", "date", "confidence")


@query("top_features", sql("""
    SELECT ticker, date, k AS rank, feature, value, shap_value, direction, magnitude FROM ranked WHERE k <= 5""", "ranked", extra=_PRED))
def _(t: Tables):
    ranks = t.predictions().select("ticker", "date", F.posexplode("top_features").alias("rank", "c"))
    return ranks.select("ticker", "date", (F.col("rank") + 1).cast("long").alias("rank"), "c.*")


@query("feature_importance", sql("SELECT feature, round(avg(abs(shap_value)), 6) AS importance FROM parts GROUP BY feature", "parts", extra=_PRED))
def _(t: Tables):
    return rounded(explain.feature_importance(t.predictions()), 6, "importance")


@query("most_bullish", sql("""
    SELECT ticker, date, round(sum(shap_value), 4) AS total FROM parts GROUP BY ticker, date
    ORDER BY round(sum(shap_value), 4) DESC, ticker, date LIMIT 1""", "parts", extra=_PRED))
def _(t: Tables):
    return explain.most_bullish(t.predictions())


@query("signal_strength", sql("""
    SELECT ticker, date, feature, CASE WHEN magnitude > 0.3e0 THEN 'strongly' WHEN magnitude > 0.15e0 THEN 'moderately'
           ELSE 'mildly' END AS strength FROM parts""", "parts", extra=_PRED))
def _(t: Tables):
    parts = t.predictions().select("ticker", "date", F.explode("contributions").alias("c"))
    return parts.select("ticker", "date", "c.feature", S.signal_strength(F.col("c.magnitude")).alias("strength"))


@query("feature_labels", sql("""
    SELECT p.feature, coalesce(l.label, p.feature) AS label, coalesce(l.description, p.feature) AS description, count(*) AS rows
    FROM (SELECT feature FROM parts UNION ALL SELECT ticker FROM parts) p LEFT JOIN labels_of l ON p.feature = l.feature
    GROUP BY ALL""", "parts", "labels_of", extra=_PRED))
def _(t: Tables):
    parts = t.predictions().select("ticker", F.explode("contributions").alias("c"))
    names = parts.select("c.feature").unionAll(parts.select(F.col("ticker").alias("feature")))
    f = F.col("feature")
    return names.groupBy("feature").agg(F.count(F.lit(1)).alias("rows")).select(
        "feature", S.feature_label(f).alias("label"), S.feature_description(f).alias("description"), "rows")


@query("template_explanation", sql(_EXPLAINED, "ranked", "labels_of", extra=_PRED))
def _(t: Tables):
    return explain.template_explanations(t.predictions()).select("ticker", "date", "explanation")


@query("word_count", sql(f"""
    SELECT ticker, date, len(string_split_regex(trim(explanation), '\\s+')) AS word_count FROM ({_EXPLAINED}) q""",
    "ranked", "labels_of", extra=_PRED))
def _(t: Tables):
    rows = explain.template_explanations(t.predictions())
    return rows.select("ticker", "date", S.word_count(F.col("explanation")).cast("long").alias("word_count"))


@query("explanation_key", sql("""
    SELECT ticker, date, 'explain:' || md5('{"date": "' || strftime(date, '%Y-%m-%d') || '", "features": ["' || names
        || '"], "prob_up": ' || CAST(""" + rx("prob_up", 3) + """ AS VARCHAR) || ', "ticker": "' || ticker || '"}') AS key
    FROM (SELECT ticker, date, any_value(prob_up) AS prob_up, string_agg(feature, '", "' ORDER BY k) AS names
          FROM ranked WHERE k <= 3 GROUP BY ticker, date) q""", "ranked", extra=_PRED))
def _(t: Tables):
    rows = t.predictions()
    names = F.transform("top_features", lambda c: c["feature"])
    return rows.select("ticker", "date", S.explanation_key(F.col("ticker"), F.col("date"), F.col("prob_up"), names).alias("key"))


_PROMPT = f"""'Explain a model''s forecast to a new investor: friendly, honest, under 150 words, no advice to buy or sell, every '
    || 'technical term explained.' || chr(10) || chr(10) || 'Forecast for ' || company_name || ' (' || ticker || ') as of '
    || strftime(date, '%B %d, %Y') || ':' || chr(10) || '- chance of a rise within 10 trading days: ' || {_pct('prob_up')}
    || '%' || chr(10) || '- chance of a fall: ' || {_pct('(1 - prob_up)')} || '%' || chr(10) || '- confidence: '
    || upper({_CONF.format(p='prob_up')}) || chr(10) || chr(10) || 'Strongest signals first:' || chr(10) || lines || chr(10) || chr(10)
    || 'Start with the overall picture, explain two or three signals, name conflicting ones and close with the reminder that this is a probability.'"""


@query("explanation_prompt", sql(f"""
    SELECT ticker, date, {_PROMPT} AS prompt FROM (
        SELECT ticker, date, any_value(company_name) AS company_name, any_value(prob_up) AS prob_up,
               string_agg('- ' || label || ': ' || CASE WHEN magnitude > 0.3e0 THEN 'strongly' WHEN magnitude > 0.15e0
                   THEN 'moderately' ELSE 'mildly' END || ' ' || direction || ' (measures ' || description || ')', chr(10) ORDER BY k) AS lines
        FROM ranked JOIN labels_of USING (feature) WHERE k <= 5 GROUP BY ticker, date) q""", "ranked", "labels_of", extra=_PRED))
def _(t: Tables):
    return explain.explanation_prompts(t.predictions())


@query("portfolio_prompt", sql(f"""
    SELECT ticker, (pos // 50) AS batch, count(*) AS n,
           'Explain each forecast below to a new investor in under 120 words, with its uncertainty and no advice. Reply only with JSON: '
           || '[{{"ticker": "...", "date": "yyyy-mm-dd", "explanation": "..."}}]' || chr(10) || chr(10)
           || string_agg('Ticker: ' || ticker || chr(10) || 'Date: ' || strftime(date, '%Y-%m-%d') || chr(10) || 'Company: ' || company_name
                  || chr(10) || 'Probability up: ' || {_pct('prob_up')} || '%' || chr(10) || 'Probability down: ' || {_pct('(1 - prob_up)')}
                  || '%' || chr(10) || 'Confidence: ' || {_CONF.format(p='prob_up')} || chr(10) || 'Signals:' || chr(10) || lines,
                  chr(10) || chr(10) ORDER BY date) AS prompt
    FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos FROM (
        SELECT ticker, date, any_value(company_name) AS company_name, any_value(prob_up) AS prob_up,
               string_agg('- ' || label || ': ' || direction || ' (measures ' || description || ')', chr(10) ORDER BY k) AS lines
        FROM ranked JOIN labels_of USING (feature) WHERE k <= 5 GROUP BY ticker, date) a) q
    GROUP BY ticker, pos // 50""", "ranked", "labels_of", extra=_PRED))
def _(t: Tables):
    return explain.portfolio_prompts(t.predictions())


def _replies(t: Tables):
    """Replies as a text service returns them: plain, fenced and broken JSON, one per ticker and year."""
    rows = t.predictions().groupBy("ticker", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    item = F.to_json(F.array(F.struct("ticker", F.make_date("year", F.lit(1), F.lit(2)).alias("date"), F.concat(F.lit("Seen "), F.col("n").cast("string"), F.lit(" rows.")).alias("explanation"))))
    reply = F.when(F.col("year") % 3 == 0, item).when(
        F.col("year") % 3 == 1, F.concat(F.lit("```json\n"), item, F.lit("\n```"))).otherwise(F.concat(F.lit("[{"), item))
    return rows.select("year", F.col("ticker").alias("asked"), reply.alias("reply"))


@query("parse_explanations", sql("""
    SELECT CAST(year(date) AS INTEGER) AS year, ticker AS asked, ticker, make_date(year(date), 1, 2) AS date, 'Seen ' || count(*) || ' rows.' AS explanation FROM dataset
    GROUP BY year(date), ticker HAVING year(date) % 3 <> 2""", "dataset"))
def _(t: Tables):
    return explain.parse_explanations(_replies(t))


@query("explanations_merge", sql(f"""
    SELECT e.ticker, e.date, CASE WHEN day(e.date) % 2 = 0 THEN e.ticker || ' in words, again.' ELSE e.explanation END AS explanation
    FROM ({_EXPLAINED}) e""", "ranked", "labels_of", extra=_PRED))
def _(t: Tables):
    """Replies to the predictions of even days, each of them twice."""
    rows = t.predictions().filter(F.dayofmonth("date") % 2 == 0).select("ticker", "date")
    said = [F.concat("ticker", F.lit(" in words" + end)).alias("explanation") for end in (".", ", again.")]
    replies = rows.select("*", F.lit(1).alias("batch"), said[0]).unionByName(rows.select("*", F.lit(2).alias("batch"), said[1]))
    return explain.explanations_merge(t.predictions(), replies, order=["batch"]).select("ticker", "date", "explanation")


# ---- knowledge and retrieval ---------------------------------------------------------------------------

_CHUNKS = """
    SELECT doc_id || '_chunk_' || idx AS chunk_id, doc_id, lang AS topic, source AS title, idx AS chunk_idx, text FROM (
        SELECT doc_id, lang, source, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS idx FROM (
            SELECT doc_id, lang, source, list_filter(list_transform(string_split(text, chr(10)),
                   lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS parts FROM documents) a) b
    WHERE length(text) >= 50"""


@query("chunk_documents", _CHUNKS)
def _(t: Tables):
    out = retrieval.chunk_documents(t.knowledge(), separator="\n")
    return out.withColumn("chunk_idx", F.col("chunk_idx").cast("long"))


def _asked(high: int) -> str:
    return f"""
    SELECT conv_id || '-' || turn AS query_id, text FROM conversations
    WHERE role = 'user' AND length(text) BETWEEN 5 AND {high}"""


@query("question_filter", _asked(500))
def _(t: Tables):
    return retrieval.question_filter(t.questions())


@query("question_filter_short", _asked(200))
def _(t: Tables):
    return retrieval.question_filter(t.questions(), high=200)


_DISTANCE = "list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2))"


def _hits_sql(where: str = "") -> str:
    return f"""SELECT * FROM (SELECT query_id, chunk_id, distance,
            row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank
        FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, {_DISTANCE} AS distance
              FROM embeddings q, embeddings c {where}) a) b WHERE rank <= 3"""


@query("retrieve_topk", f"SELECT query_id, rank, chunk_id, round(distance, 6) AS distance FROM ({_hits_sql()}) h")
def _(t: Tables):
    return rounded(retrieval.retrieve_topk(t.vector_queries(), t.vectors(), 3), 6, "distance")


@query("retrieve_topic", f"SELECT query_id, rank, chunk_id, round(distance, 6) AS distance FROM ({_hits_sql('WHERE c.label = 3')}) h")
def _(t: Tables):
    return rounded(retrieval.retrieve_topk(t.vector_queries(), t.vectors(), 3, topic=3), 6, "distance")


@query("retrieve_ann", """
    SELECT vec_id AS query_id, CAST(r AS INTEGER) AS rank, r > 1 OR true AS found
    FROM embeddings, (VALUES (1), (2), (3)) v(r)""")
def _(t: Tables):
    """The ranks found, that a vector of the collection finds itself or its equal first, and that the recall is reached."""
    hits = _retrieve_ann(t)
    first = (F.col("rank") > 1) | (F.col("distance") == 0)
    return hits.select("query_id", "rank", (first & (F.col("recall") >= 0.9)).alias("found"))


@query("retrieve_ann_scores")
def _retrieve_ann(t: Tables):
    """Hits, and the recall measured on exactly searched queries."""
    return rounded(retrieval.retrieve_topk(t.vector_queries(), t.vectors(), 3, recall=0.95), 6, "distance")


def _text_hits(t: Tables):
    hits = retrieval.retrieve_topk(t.vector_queries(), t.vectors(), 3)
    return retrieval.hits_with_text(hits, t.vector_texts())


_TEXT_HITS = f"SELECT h.*, d.source AS title, d.text AS content FROM ({_hits_sql()}) h JOIN documents d ON d.doc_id = h.chunk_id"


@query("build_context", f"""
    SELECT e.vec_id AS query_id, coalesce(string_agg('[Source: ' || h.title || ']' || chr(10) || h.content, chr(10) || chr(10)
           ORDER BY h.rank), 'No relevant context found.') AS context
    FROM embeddings e LEFT JOIN ({_TEXT_HITS}) h ON h.query_id = e.vec_id GROUP BY e.vec_id""")
def _(t: Tables):
    return retrieval.build_context(t.vector_queries(), _text_hits(t))


@query("sources", f"""
    SELECT query_id, list_sort(list_distinct(list(title))) AS sources FROM ({_TEXT_HITS}) h GROUP BY query_id""")
def _(t: Tables):
    return retrieval.sources(_text_hits(t))


def _embedder(t: Tables):
    """Chunks with their counted words, written without the texts, and the model of their vectors."""
    chunks = retrieval.chunk_documents(t.knowledge(), separator="\n").select("chunk_id", "topic", "text")
    # Read again for the fit and for the vectors, by as many tasks as a shuffle has; words are counted once.
    chunks = chunks.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    chunks = staging.written(text_score.count_words(chunks).drop("text"), "chunks")
    return chunks, text_score.embedder(chunks, dims=128)


@query("embed_chunks")
def _(t: Tables):
    chunks, model = _embedder(t)
    return text_score.embed(model, chunks).select("chunk_id", "topic", "vector")


@query("embed_chunks_norms", f"SELECT chunk_id, topic, 128 AS dims, 1.0 AS norm FROM ({_CHUNKS}) c")
def _(t: Tables):
    """Width and length of every chunk's vector."""
    chunks, model = _embedder(t)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return text_score.embed(model, chunks).select("chunk_id", "topic", F.size("vector").alias("dims"), F.round(norm, 5).alias("norm"))


@query("qa_prompts_vectors", f"""
    SELECT q.vec_id AS query_id, 'Answer a question of a new investor from the context only; say so when it is not enough. '
           || 'Use plain English and fewer than 120 words. Give no advice to buy or sell.'
           || chr(10) || chr(10) || 'Context:' || chr(10) || c.context || chr(10) || chr(10) || 'Question: ' || d.text AS prompt
    FROM embeddings q JOIN documents d ON d.doc_id = q.vec_id AND length(d.text) BETWEEN 5 AND 500
    JOIN (SELECT query_id, string_agg('[Source: ' || h.title || ']' || chr(10) || h.content, chr(10) || chr(10) ORDER BY h.rank) AS context
          FROM ({_TEXT_HITS}) h GROUP BY query_id) c ON c.query_id = q.vec_id""")
def _(t: Tables):
    """Prompts of the documents that are short enough to be questions, by their given vectors."""
    questions = t.vector_queries().join(retrieval.question_filter(t.vector_texts()), F.col("chunk_id") == F.col("query_id"))
    questions = questions.select("query_id", "vector", F.col("text").alias("question"))
    hits = retrieval.hits_with_text(retrieval.retrieve_topk(questions, t.vectors(), 3), t.vector_texts())
    return retrieval.qa_prompts(questions, retrieval.build_context(questions, hits))


@query("qa_prompts")
def _(t: Tables):
    chunks, model = _embedder(t)
    questions = retrieval.question_filter(t.questions())
    hits = retrieval.retrieve_topk(text_score.embed(model, questions), chunks.drop("topic"), 3,
                                   embed=lambda rows: text_score.embed(model, rows))
    texts = retrieval.chunk_documents(t.knowledge(), separator="\n")
    contexts = retrieval.build_context(questions, retrieval.hits_with_text(hits, texts))
    return retrieval.qa_prompts(questions.withColumnRenamed("text", "question"), contexts)


@query("score_text", "SELECT doc_id, true AS in_range FROM documents")
def _(t: Tables):
    return _score_text(t).select("doc_id", F.col("sentiment_score").between(-1.0, 1.0).alias("in_range"))


@query("score_text_scores")
def _score_text(t: Tables):
    """News-like scores of every document by a model trained on the labelled ones."""
    label = F.when(F.col("toxic") == 1, text_score.NEGATIVE).when(F.col("quality") == 1, text_score.POSITIVE) \
        .otherwise(text_score.NEUTRAL).cast("double")
    docs = t.raw("documents").select("doc_id", "text")
    known = docs.join(t.raw("labels").select("doc_id", label.alias("label")), "doc_id")
    return text_score.score_texts(text_score.train_scorer(known), docs).select("doc_id", "sentiment_score")
