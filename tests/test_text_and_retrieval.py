import datetime as dt
import hashlib
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewise.functions import scalar as S
from tapewise.operators import explain, linear, retrieval, text_score
from tapewise.plans import catalog
from tapewise.sources import staging


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_headline_text(spark):
    rows = [("a", "b"), ("a", ""), ("a", "nan"), ("a", None), (" a ", " b "), ("h" * 900, "d" * 900)]
    df = spark.createDataFrame(rows, "h string, d string")
    got = [r[0] for r in df.select(S.headline_text(F.col("h"), F.col("d"))).collect()]
    assert got[:5] == ["a. b", "a", "a", "a", "a. b"] and got[5] == "h" * 900 + ". " + "d" * 900
    assert df.select(S.headline_text(F.col("h"), F.col("d"), 1000)).collect()[5][0] == got[5][:1000]


def test_word_count(spark):
    df = spark.createDataFrame([("",), ("  ",), ("a",), (" a\n b\tc ",)], "t string")
    assert [r[0] for r in df.select(S.word_count(F.col("t"))).collect()] == [0, 0, 1, 3]


@pytest.mark.parametrize("score,label", [(0.31, "STRONGLY POSITIVE"), (0.3, "MILDLY POSITIVE"), (0.1, "NEUTRAL"),
                                         (-0.1, "MILDLY NEGATIVE"), (-0.3, "STRONGLY NEGATIVE")])
def test_sentiment_label_bounds_are_strict(spark, score, label):
    assert one(spark, S.sentiment_label(F.lit(score))) == label


def test_explanation_key(spark):
    content = json.dumps({"ticker": "A", "date": "2024-01-02", "prob_up": round(0.56789, 3), "features": ["x", "y", "z"]}, sort_keys=True)
    want = "explain:" + hashlib.md5(content.encode()).hexdigest()
    names = F.array(*[F.lit(c) for c in "xyzw"])
    assert one(spark, S.explanation_key(F.lit("A"), F.lit(dt.date(2024, 1, 2)), F.lit(0.56789), names)) == want


def test_template_without_features(spark):
    text = one(spark, S.template_explanation(F.lit("Acme"), F.lit(0.4), F.lit("low"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    assert text.startswith("Acme shows a 40.0% probability of a price fall") and "technical indicators, which is currently neutral" in text


def test_top_features_keep_feature_order_on_ties(spark):
    parts = explain.contribution_array(list("abcdef"), [F.lit(1.0)] * 6, [F.lit(v) for v in (0.1, -0.3, 0.1, 0.3, 0.00001, 0.2)])
    got = one(spark, F.transform(explain.top_features(parts), lambda c: c["feature"]))
    assert got == ["b", "d", "f", "a", "c"]


def test_parse_explanations(spark):
    good = json.dumps([{"ticker": "A", "date": "2024-01-02", "explanation": "x"}, {"ticker": "B", "date": "2024-01-02", "explanation": "y"}])
    replies = [good, f"```json\n{good}\n```", "not json", "[{\"ticker\": \"A\"}]", "[]", "  " + good + " \n"]
    df = spark.createDataFrame(list(enumerate(replies)), "i int, reply string")
    got = explain.parse_explanations(df).groupBy("i").count().collect()
    assert {r["i"]: r["count"] for r in got} == {0: 2, 1: 2, 5: 2}


def test_explanations_merge(spark):
    feature = explain.contribution_array(["rsi"], [F.lit(1.0)], [F.lit(0.2)])
    day, other = dt.date(2024, 1, 2), dt.date(2024, 1, 3)
    df = spark.createDataFrame([("A", day), ("A", other), ("B", day)], "ticker string, date date").select(
        "ticker", "date", F.lit("N").alias("company_name"), F.lit(0.7).alias("prob_up"), F.lit("low").alias("confidence"), feature.alias("top_features"))
    replies = spark.createDataFrame([("A", day, "hello", 2), ("A", day, "zero", 1), ("A", other, "later", 1)], "ticker string, date date, explanation string, n int")
    rows = explain.explanations_merge(df, replies, order=["n"]).collect()
    got = {(r["ticker"], r["date"]): r["explanation"] for r in rows}
    assert len(rows) == 3 and got["A", day] == "hello" and got["A", other] == "later" and got["B", day].startswith("N shows a 70.0%")


def test_prompts_hold_every_prediction(spark):
    feature = explain.contribution_array(["rsi"], [F.lit(1.0)], [F.lit(0.2)])
    df = spark.range(230).select(
        F.concat(F.lit("T"), "id").alias("ticker"), F.lit(dt.date(2024, 1, 2)).alias("date"), F.lit("N").alias("company_name"),
        F.lit(0.7).alias("prob_up"), F.lit("low").alias("confidence"), feature.alias("top_features"))
    hot = df.withColumns({"ticker": F.lit("HOT"), "date": F.date_add(F.lit(dt.date(2020, 1, 1)), F.expr("cast(substring(ticker, 2) AS int)"))})
    batches = explain.portfolio_prompts(df.unionByName(hot), per_prompt=50).toPandas()
    assert batches["n"].sum() == 460 and batches["n"].max() == 50 and sorted(batches[batches["ticker"] == "HOT"]["n"]) == [30, 50, 50, 50, 50]
    prompt = explain.explanation_prompts(df).first()["prompt"]
    assert "RSI momentum indicator: moderately bullish (measures whether the stock is overbought or oversold)" in prompt
    assert "January 02, 2024" in prompt


def test_chunks_keep_their_numbers(spark):
    long = "x" * 60
    docs = spark.createDataFrame([("d", "t", "T", f"{long}\n\n  \n\nshort\n\n  {long}y  ")], "id string, topic string, title string, content string")
    got = retrieval.chunk_documents(docs).orderBy("chunk_idx").collect()
    assert [(r["chunk_id"], r["text"]) for r in got] == [("d_chunk_0", long), ("d_chunk_2", long + "y")]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 3, (12, 16))
    c = centres[rng.integers(0, 12, 3000)] + rng.normal(0, 0.4, (3000, 16))
    c[10:20] = c[0]  # equal distances
    q = centres[rng.integers(0, 12, 150)] + rng.normal(0, 0.4, (150, 16))
    chunks = spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(c)], "chunk_id long, vector array<float>, topic int").cache()
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.vstack([q, c[:1]]))], "query_id long, vector array<float>").cache()
    d = ((np.vstack([q, c[:1]]).astype("float32").astype(float)[:, None, :] - c.astype("float32").astype(float)[None]) ** 2).sum(2)
    return queries, chunks, d


def found(df, n):
    out = [[] for _ in range(n)]
    for r in df.orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["chunk_id"], r["distance"]))
    return out


def test_exact_retrieval_equals_brute_force(vectors, monkeypatch):
    queries, chunks, d = vectors
    monkeypatch.setattr(retrieval, "_CHUNKS_PER_TASK", 100)  # many parts on both sides
    got = found(retrieval.retrieve_topk(queries, chunks, 12), len(d))
    for i, row in enumerate(d):
        order = np.lexsort((np.arange(len(row)), row))[:12]
        assert [g[0] for g in got[i]] == list(order)
        np.testing.assert_allclose([g[1] for g in got[i]], row[order], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("folder,share", [("sf0.01", 0.85), ("sf0.1", 0.8)])
def test_exact_search_of_the_given_vectors_multiplies_less(spark, folder, share):
    """Against all components of all pairs; the vectors have no leading directions, so most of each is looked at."""
    chunks = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").selectExpr("vec_id AS chunk_id", "embedding AS vector")
    held = chunks.toPandas()
    part = retrieval._Part(held, retrieval._Turned(chunks, len(held["vector"][0])))
    work: list[int] = []
    got = part.nearest(held.rename(columns={"chunk_id": "key"}).assign(limit=np.inf), 3, work)
    assert sum(work) < share * part.at.shape[1] * len(held) ** 2
    x = np.stack(held["vector"]).astype(float)
    ids = held["chunk_id"].to_numpy()
    want = {i: ids[np.lexsort((ids, ((x - v) ** 2).sum(1)))[:3]].tolist() for i, v in zip(ids, x)}
    assert got.groupby("key")["chunk_id"].agg(list).to_dict() == want


def test_neither_side_of_the_search_is_copied_per_cell(vectors, monkeypatch):
    queries, chunks, d = vectors
    monkeypatch.setattr(retrieval, "_ASKED", 16)  # many blocks of queries
    monkeypatch.setattr(retrieval, "_HELD_BYTES", 1 << 14)  # and several groups of chunks a task
    hits = retrieval.retrieve_topk(queries, chunks.withColumn("chunk_id", F.lpad(F.col("chunk_id").cast("string"), 5, "0")), 4)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(cell" not in plan and "Generate" not in plan
    got = found(hits, len(d))
    for i, row in enumerate(d):
        assert [int(g[0]) for g in got[i]] == list(np.lexsort((np.arange(len(row)), row))[:4])


def test_search_far_from_the_origin_is_exact(spark):
    """Where single precision alone would not tell the chunks apart."""
    x = np.random.default_rng(9).normal(size=(600, 24))
    x[:300] = x[:300] * 1e-4 + 1e4
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, vector array<double>")
    got = found(retrieval.retrieve_topk(chunks.withColumnRenamed("chunk_id", "query_id"), chunks, 3), len(x))
    for i, v in enumerate(x):
        assert [g[0] for g in got[i]] == list(np.lexsort((np.arange(len(x)), ((x - v) ** 2).sum(1)))[:3])


def test_leading_directions_save_most_products(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 96)) * np.exp(-np.arange(96) / 6.0) + 3.0
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, vector array<double>")
    turned = retrieval._Turned(chunks, 96)
    assert turned.leading < 20
    y, s = turned(x), turned.shadow(x)
    some = rng.integers(0, len(x), (500, 2))
    d = ((x[some[:, 0]] - x[some[:, 1]]) ** 2).sum(1)
    np.testing.assert_allclose(((y[some[:, 0]] - y[some[:, 1]]) ** 2).sum(1), d, rtol=1e-9, atol=1e-9)
    assert (((s[some[:, 0]] - s[some[:, 1]]) ** 2).sum(1) <= d * (1 + 1e-9) + 1e-9).all()
    work: list[int] = []
    held = pd.DataFrame({"chunk_id": np.arange(len(x)), "vector": list(x)})
    retrieval._Part(held, turned).nearest(pd.DataFrame({"key": np.arange(300), "vector": list(x[:300]), "limit": np.inf}), 5, work)
    assert sum(work) < 0.35 * 96 * len(x) * 300


def test_retrieval_leaves_out_missing_vectors_and_keeps_repeated_queries(spark):
    chunks = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [0.0, 3.0])], "chunk_id long, vector array<double>")
    queries = spark.createDataFrame([("a", [0.0, 0.0]), ("b", None), ("a", [0.0, 0.0]), (None, [0.0, 4.0])], "query_id string, vector array<double>")
    got = retrieval.retrieve_topk(queries, chunks, 2).collect()
    assert sorted((r["query_id"] or "", r["rank"], r["chunk_id"], r["distance"]) for r in got) == [
        ("", 1, 3, 1.0), ("", 2, 1, 9.0), ("a", 1, 1, 1.0), ("a", 2, 1, 1.0)]
    assert retrieval.retrieve_topk(queries.limit(0), chunks, 2).count() == 0


def test_topic_filter_and_small_collections(vectors):
    queries, chunks, d = vectors
    got = found(retrieval.retrieve_topk(queries, chunks, 3, topic=2), len(d))
    for i, row in enumerate(d):
        ids = np.arange(2, len(row), 4)
        assert [g[0] for g in got[i]] == list(ids[np.lexsort((ids, row[ids]))[:3]])
    few = found(retrieval.retrieve_topk(queries, chunks.filter("chunk_id < 2"), 3), len(d))
    assert all(len(g) == 2 for g in few)  # k is at most the number of chunks
    assert retrieval.retrieve_topk(queries, chunks.filter("chunk_id < 0"), 3).count() == 0


def test_approximate_retrieval_recall(vectors):
    queries, chunks, d = vectors
    got = found(retrieval.retrieve_topk(queries, chunks, 5, probes=6), len(d))
    hit = np.mean([len({g[0] for g in got[i]} & set(np.lexsort((np.arange(d.shape[1]), d[i]))[:5])) / 5 for i in range(len(d))])
    assert hit > 0.8


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_calibrated_recall_on_the_given_table(spark, folder):
    rows = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    hits = catalog.QUERIES["retrieve_ann_scores"](spark, f"/root/testdata/{folder}").collect()
    got = {i: set() for i in ids}
    for r in hits:
        got[r["query_id"]].add(r["chunk_id"])
    assert all(len(g) == 3 for g in got.values())
    found = []
    for i, v in zip(ids, x):
        d = ((x - v) ** 2).sum(1)
        near = np.lexsort((ids, d))[:3]
        found += [ids[n] in got[i] for n in near if d[n] > 0]  # the vector itself is no achievement
    assert np.mean(found) >= 0.9
    assert {round(r["recall"], 9) for r in hits} == {round(hits[0]["recall"], 9)} and 0.95 <= hits[0]["recall"] <= 1


def test_approximate_retrieval_fills_the_ranks(vectors):
    queries, chunks, d = vectors
    got = found(retrieval.retrieve_topk(queries, chunks, 40, probes=1), len(d))
    assert all(len(g) == 40 for g in got)


def test_context_sources_and_prompts(spark):
    queries = spark.createDataFrame([("q1", "why?"), ("q2", "who?")], "query_id string, question string")
    hits = spark.createDataFrame([("q1", 2, "T", "b"), ("q1", 1, "U", "a"), ("q1", 3, "T", "c")], "query_id string, rank int, title string, content string")
    context = {r["query_id"]: r["context"] for r in retrieval.build_context(queries, hits).collect()}
    assert context == {"q1": "[Source: U]\na\n\n[Source: T]\nb\n\n[Source: T]\nc", "q2": "No relevant context found."}
    assert retrieval.sources(hits).first()["sources"] == ["T", "U"]
    prompts = retrieval.qa_prompts(queries.withColumn("ticker", F.lit("A")), retrieval.build_context(queries, hits)).collect()
    assert len(prompts) == 2 and all("about A." in p["prompt"] and "Context:" in p["prompt"] for p in prompts)
    assert "Context:" not in retrieval.qa_prompts(queries, None).first()["prompt"]
    assert retrieval.question_filter(queries, "question", 5, 500).count() == 0


def test_scorers(spark):
    texts = spark.createDataFrame([("good great", 1.0), ("bad awful", 2.0), ("plain words", 0.0)] * 10, "text string, label double")
    model = text_score.train_scorer(texts, size=64)
    got = {r["text"]: r["sentiment_score"] for r in text_score.score_texts(model, texts.select("text").distinct()).collect()}
    assert got["good great"] > 0.3 > -0.3 > got["bad awful"] and abs(got["plain words"]) < 0.3
    custom = text_score.score_with(texts.select("text"), lambda s: s.str.len() / 100.0)
    assert custom.filter("text = 'bad awful'").first()["sentiment_score"] == 0.09


def test_leading_directions_equal_a_whole_decomposition(spark):
    rng = np.random.default_rng(1)
    a, rows = np.zeros((700, 400)), [([], [])]
    for i in range(700):
        at = np.sort(rng.choice(400, rng.integers(0, 30), replace=False))
        a[i, at] = rng.random(len(at)) / (1 + at) ** 0.7
        rows.append((at.tolist(), a[i, at].tolist()))
    table = spark.createDataFrame(rows, "indices array<int>, values array<double>").repartition(5)
    values, right = linear.leading_directions(table, 400, 12)
    want = np.linalg.svd(a)[1][:12]
    np.testing.assert_allclose(values, want, rtol=0.01)
    np.testing.assert_allclose(right.T @ right, np.eye(12), atol=1e-9)
    np.testing.assert_allclose(np.linalg.norm(a @ right, axis=0), want, rtol=0.01)
    values, right = linear.leading_directions(table, 400, 500)  # more than there are
    np.testing.assert_allclose(values, np.linalg.svd(a)[1], atol=1e-4)
    assert right.shape == (400, 400) and not linear.leading_directions(table.limit(0), 400, 5)[0].any()


def test_weighted_sums_equal_plain_ones():
    rng = np.random.default_rng(4)
    lengths = np.array([1, 16, 17, 5000, 2, 300])
    index, value, table = rng.integers(0, 50, lengths.sum()), rng.normal(size=lengths.sum()), rng.normal(size=(50, 7))
    want = np.zeros((len(lengths), 7))
    np.add.at(want, np.repeat(np.arange(len(lengths)), lengths), value[:, None] * table[index])
    np.testing.assert_allclose(linear._weighted_sums(table, index, value, np.cumsum(lengths) - lengths), want, rtol=1e-9, atol=1e-9)


def test_counted_words_give_the_vectors_of_their_texts(spark):
    rng = np.random.default_rng(6)
    texts = spark.createDataFrame([(i, " ".join(f"w{n}" for n in rng.integers(0, 60, 12))) for i in range(80)] + [(80, None), (81, "")], "id int, text string")
    counted = text_score.count_words(texts, 256)
    plain, again = ({r["id"]: r["vector"] for r in text_score.embed(text_score.embedder(df, size=256, dims=8), df).collect()} for df in (texts, counted))
    assert plain.keys() == again.keys() and not any(plain[80]) and not any(again[80])
    for i in plain:
        np.testing.assert_allclose(plain[i], again[i], atol=1e-4)


def test_moments_and_basis(spark):
    x = np.random.default_rng(2).normal(2, 1, (300, 5)) * [5, 1, 3, 0, 2]
    mean, second = linear.moments(spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(3), "v", 5)
    np.testing.assert_allclose(mean, x.mean(0))
    np.testing.assert_allclose(second, np.cov(x.T, bias=True), atol=1e-9)
    basis, share = linear.orthogonal_basis(second)
    np.testing.assert_allclose(basis @ basis.T, np.eye(5), atol=1e-9)
    assert (np.diff(share) <= 1e-12).all() and share.sum() == pytest.approx(1)


def test_dense_vectors_find_copies_as_hashed_ones_do(spark):
    """Texts with a fifth of their words replaced find their originals."""
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(2000)])
    texts = [words[rng.choice(2000, 30)] for _ in range(300)]
    asked = [np.where(rng.random(30) < 0.2, words[rng.choice(2000, 30)], t) for t in texts]
    chunks = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "chunk_id long, text string").cache()
    queries = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(asked)], "query_id long, text string")
    share = {}
    for dims in (None, 64):
        model = text_score.embedder(chunks, size=1 << 12, dims=dims)
        hits = retrieval.retrieve_topk(text_score.embed(model, queries), text_score.embed(model, chunks), 1)
        share[dims] = hits.filter("query_id = chunk_id").count() / 300
    assert share[None] > 0.95 and share[64] > 0.9
    odd = spark.createDataFrame([(None,), ("",), ("unheard of",), (" ".join(texts[0]) * 500,)], "text string")
    got = [np.array(r["vector"]) for r in text_score.embed(model, odd).collect()]
    assert all(len(v) == 64 and np.isfinite(v).all() for v in got) and not got[0].any() and not got[1].any()
    assert np.linalg.norm(got[3]) == pytest.approx(1, abs=1e-5)


def test_prompts_write_neither_texts_nor_vectors_of_chunks(spark, monkeypatch):
    """What is written or shuffled on the way grows with the counted words of the chunks, not with their texts and vectors."""
    tables = {}

    def noted(df, name, plain=staging.written):
        tables[name] = set(df.columns)
        return plain(df, name)

    monkeypatch.setattr(retrieval, "written", noted)
    monkeypatch.setattr(staging, "written", noted)
    assert catalog.QUERIES["qa_prompts"](spark, "/root/testdata/sf0.001").count() > 0
    assert tables.keys() == {"chunks", "placed", "asked", "bounded"}
    assert not {"text", "vector"} & (tables["chunks"] | tables["placed"])


@pytest.mark.parametrize("topic", [None, 1])
def test_vectors_made_on_the_way_are_found_as_written_ones(spark, topic):
    rng = np.random.default_rng(8)
    chunks = spark.createDataFrame([(i, i % 3, rng.integers(-4, 5, 6).tolist()) for i in range(700)], "chunk_id long, topic int, words array<int>").repartition(5).cache()

    def embed(rows):
        return rows.withColumn("vector", F.transform("words", lambda w: w.cast("double") / 3)).drop("words")

    queries = spark.createDataFrame([(i, rng.normal(0, 1, 6).tolist()) for i in range(60)] + [(60, None)], "query_id long, vector array<double>")
    want, got = (sorted(map(tuple, hits.collect())) for hits in (
        retrieval.retrieve_topk(queries, embed(chunks), 4, topic=topic), retrieval.retrieve_topk(queries, chunks, 4, topic=topic, embed=embed)))
    assert want == got and len(got) == 240


def test_vectors_are_made_four_times_and_for_samples(spark):
    """For the moments, the cells, the first bounds and the search; what is known of cells and ranges costs no pass of its own."""
    made = spark.sparkContext.accumulator(0)
    rng = np.random.default_rng(9)
    n = 20_000
    chunks = spark.createDataFrame([(i, v) for i, v in enumerate(rng.integers(-4, 5, (n, 6)).tolist())], "chunk_id long, words array<int>").repartition(5).cache()

    @F.pandas_udf("array<double>")
    def vector(words: pd.Series) -> pd.Series:
        made.add(len(words))
        return words.map(lambda w: [x / 3 for x in w])

    queries = spark.createDataFrame([(i, rng.normal(0, 1, 6).tolist()) for i in range(60)], "query_id long, vector array<double>")
    hits = retrieval.retrieve_topk(queries, chunks, 4, embed=lambda rows: rows.withColumn("vector", vector("words")).drop("words"))
    assert hits.count() == 240
    assert 4 * n <= made.value < 4.2 * n


def test_regions_are_searched_by_directions_of_their_own():
    """Groups of 400 vectors, each group in 8 directions of its own: few coordinates tell which vectors are too far, and none is lost."""
    rng = np.random.default_rng(10)
    spans = [np.linalg.qr(rng.normal(size=(64, 8)))[0] for _ in range(10)]
    x = np.concatenate([rng.normal(size=(400, 8)) @ span.T for span in spans]) + rng.normal(0, 0.01, (4000, 64))
    turned = retrieval._Turned(x, 64)
    work: dict[bool, list[int]] = {False: [], True: []}
    for g in range(10):
        own = x[g * 400:g * 400 + 400]
        asked = own[:100] + rng.normal(0, 0.01, (100, 64))
        exact = ((asked[:, None, :] - own[None]) ** 2).sum(2)
        limit = np.sort(exact, axis=1)[:, 2]
        for local in (False, True):
            part = retrieval._Part({"chunk_id": np.arange(400), "vector": own}, turned, local)
            q = part.turned(asked)
            if local:
                part.suit(q, limit)
            i, j = part.near(q, 3, limit, work[local])
            assert set(zip(*np.nonzero(exact <= limit[:, None]))) <= set(zip(i.tolist(), j.tolist()))
    assert sum(work[True]) < 0.5 * sum(work[False])


def test_few_true_places():
    rng = np.random.default_rng(11)
    for n in (0, 5, 8, 4099):
        flags = rng.random(n) < 0.02
        assert retrieval._places(flags).tolist() == np.flatnonzero(flags).tolist()


def test_shuffles_of_a_written_table_are_dropped(spark):
    """Nothing that a write or a collected sum shuffled stays on disk, and the session's setting is as before."""
    def shuffled():
        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        files = manager.getAllFiles().mkString("\n").split("\n")
        return {f for f in files if "shuffle_" in f}

    before, setting = shuffled(), spark.conf.get(staging._CLEANUP)
    table = staging.written(spark.range(5000).repartition(4), "shuffled")
    mean, _ = linear.moments(table.select(F.array(F.col("id").cast("double")).alias("v")), "v", 1)
    assert not shuffled() - before
    assert table.count() == 5000 and mean[0] == pytest.approx(2499.5)
    assert spark.conf.get(staging._CLEANUP) == setting
