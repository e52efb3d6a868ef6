from itertools import product

import numpy as np

from tapewise.llm import crf_quality, ordinal_toxicity
from tapewise.llm.common import table
from tapewise.llm.labelled import held_out
from tests.conftest import SMALL

LARGER = "/root/testdata/sf0.01"


def accuracy(scored, labels, label):
    rows = scored.join(labels.select("doc_id", label), "doc_id").select("held_out", "predicted", label).collect()
    return {h: np.mean([r["predicted"] == r[label] for r in rows if r["held_out"] == h]) for h in (True, False)}


def test_marginals_equal_the_sum_over_all_labellings():
    rng = np.random.default_rng(0)
    per_text, step = np.array([3, 0, 1, 5]), rng.normal(size=(2, 2))
    good = rng.normal(size=9) * 2
    got, pairs = crf_quality.marginals(good, per_text, step)
    want, moves, at = [], np.zeros((2, 2)), 0
    for n in per_text:
        if not n:
            continue
        total, each, own = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in product((0, 1), repeat=int(n)):
            w = np.exp(sum(good[at + t] * y[t] for t in range(n)) + sum(step[a, b] for a, b in zip(y, y[1:])))
            total += w
            each += w * np.array(y)
            for a, b in zip(y, y[1:]):
                own[a, b] += w
        want += list(each / total)
        moves += own / total
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, moves)


def test_quality_is_learned_and_holds_on_rows_left_out(spark):
    docs, labels = table(spark, LARGER, "documents"), table(spark, LARGER, "labels")
    scored = crf_quality.score(docs, crf_quality.fit(docs, labels)).cache()
    assert scored.count() == docs.count() and scored.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert min(accuracy(scored, labels, "quality").values()) > 0.93


def test_toxicity_is_learned_and_severity_follows_the_amount(spark):
    docs, labels = table(spark, LARGER, "documents"), table(spark, LARGER, "labels")
    model = ordinal_toxicity.fit(docs, labels)
    scored = ordinal_toxicity.grade(docs, model).cache()
    assert min(accuracy(scored, labels, "toxic").values()) > 0.9
    rows = spark.createDataFrame([(0, "the of and"), (1, "the idiot of and"), (2, "idiot moron " * 6)], "doc_id long, text string")
    severity = [r["expected_severity"] for r in ordinal_toxicity.grade(rows, model).orderBy("doc_id").collect()]
    assert severity[0] < severity[1] < severity[2] <= 3
    assert (np.diff(model.cuts) > 0).all() and (model.weights >= 0).all()


def test_held_out_rows_teach_nothing(spark):
    """Labels of held-out rows may say anything: the fitted model is the same."""
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    turned = labels.withColumn("quality", (~held_out()).cast("int") * labels["quality"] + held_out().cast("int") * (1 - labels["quality"]))
    a, b = (crf_quality.score(docs, crf_quality.fit(docs, x)).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b and any(r["held_out"] for r in a)


def test_odd_documents_and_labels(spark, odd_docs, odd_rows, no_docs):
    kinds = "doc_id long, quality int, toxic int, score double"
    some = spark.createDataFrame([(1, 1, 0, 0.1), (2, 0, 1, 0.2), (4, 1, 0, 0.3), (9, 0, 1, None), (10, None, None, 0.0), (None, 1, 1, 0.0), (11, 7, 7, 0.0)], kinds)
    for labels in (some, some.limit(0), some.filter("doc_id = 1")):
        for docs, n in ((odd_docs, len(odd_rows)), (no_docs, 0)):
            assert crf_quality.score(docs, crf_quality.fit(docs, labels)).filter("score BETWEEN 0 AND 1").count() == n
            assert ordinal_toxicity.grade(docs, ordinal_toxicity.fit(docs, labels)).filter("score BETWEEN 0 AND 1").count() == n


def test_filters_keep_all_columns_and_agree_with_the_scores(spark, odd_docs):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    field, model = crf_quality.fit(docs, labels), ordinal_toxicity.fit(docs, labels)
    good = {r["doc_id"] for r in crf_quality.score(docs, field).filter("predicted = 1").collect()}
    clean = {r["doc_id"] for r in ordinal_toxicity.grade(docs, model).filter("predicted = 0").collect()}
    assert {r["doc_id"] for r in crf_quality.keep_good(docs, field).collect()} == good
    assert {r["doc_id"] for r in ordinal_toxicity.keep_clean(docs, model).collect()} == clean
    for kept in (crf_quality.keep_good(odd_docs, crf_quality.LineField()), ordinal_toxicity.keep_clean(odd_docs, None)):
        assert kept.schema == odd_docs.schema and kept.count() == odd_docs.count()


def test_labels_of_one_class_reject_nothing(spark, odd_docs):
    few = [(1, 0, "a good line of text\n"), (2, 0, "another"), (4, 1, ""), (9, 0, " \n\n")]
    docs = spark.createDataFrame([(i, t) for i, _, t in few], "doc_id long, text string")
    bad = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, quality int")
    for some, labels in ((docs, bad), (odd_docs, bad), (docs.withColumn("text", docs["text"].substr(1, 0)), spark.createDataFrame([(i, q) for i, q, _ in few], "doc_id long, quality int"))):
        field = crf_quality.fit(some, labels)
        assert field.weights is None and field.prior < crf_quality.GOOD
        kept = crf_quality.keep_good(some, field)
        assert kept.schema == some.schema and kept.count() == some.count()


def test_junk_at_the_ends_of_long_documents_is_learned_as_junk(spark):
    prose, junk = "a plain line of quiet words\n", "$$$ BUY!!! | 999 | NOW!!!\n"
    rows = [(i, i % 2, prose * 100 if i % 2 else junk * 40 + prose * 80 + junk * 40) for i in range(80)]
    docs, labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string"), spark.createDataFrame([(i, q) for i, q, _ in rows], "doc_id long, quality int")
    for lines in (crf_quality.LINES, 1500, 0):  # all documents, some of them, one of each label
        scored = crf_quality.score(docs, crf_quality.fit(docs, labels, lines=lines)).collect()
        assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in scored]) == 1


def test_documents_within_the_lines_are_whole():
    known = [{"doc_id": i, "lines": n, "labels": [y]} for i, n, y in ((1, 5, 0), (2, 4, 0), (3, 9, 0), (4, 1, 0), (5, 7, 1), (6, 1, 1))]
    assert crf_quality._within(known, 100) == [1, 2, 3, 4, 5, 6]
    assert crf_quality._within(known, 10) == [1, 2, 5] and crf_quality._within(known, 0) == [1, 5]


def test_ordinal_fit_is_the_maximum_of_the_penalised_likelihood():
    """Against an ascent by differences of the stated objective, on a small table whose grades follow the model."""
    rng = np.random.default_rng(12)
    n, x = 400, rng.integers(0, 4, (400, 2)).astype(float)
    s = x @ [0.9, 0.4]
    grade = (s[:, None] + rng.logistic(size=(n, 1)) > np.array([1.0, 2.0, 3.5])).sum(axis=1)

    def objective(theta):
        weights, cuts = theta[:2], theta[2:]
        above = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(cuts[None, :] - (x @ weights)[:, None])), np.zeros((n, 1))], axis=1)
        likely = above[np.arange(n), grade] - above[np.arange(n), grade + 1]
        return np.log(np.maximum(likely, 1e-12)).mean() - ordinal_toxicity.RIDGE / 2 * (weights ** 2).sum()

    def slope(theta):
        return np.array([(objective(theta + e) - objective(theta - e)) / 2e-5 for e in np.eye(5) * 1e-5])

    of, feature = np.repeat(np.arange(n), 2), np.tile([0, 1], n)
    model = ordinal_toxicity.OrdinalModel.fit(np.array([5, 9]), of, feature, x.ravel(), grade)
    got = np.concatenate([model.weights, model.cuts])
    best = np.array([0.0, 0.0, -1.0, 0.0, 1.0])
    for _ in range(6000):
        best = best + 0.5 * slope(best)
        best[:2] = np.maximum(best[:2], 0)
    assert np.abs(slope(best)).max() < 1e-5
    assert objective(got) > objective(best) - 1e-4 and np.abs(slope(got)).max() < 5e-3
    np.testing.assert_allclose(got, best, atol=0.05)
    assert (np.diff(model.cuts) > 0).all() and (model.weights >= 0).all()
