"""Each stage on its own input, against plain Python or its operator's decisions."""

from collections import Counter

import __spark_entry__ as entry
import corpus_pipeline
from tapewise.llm import crf_quality, ordinal_toxicity, pii
from tapewise.llm.common import table
from tests.conftest import SMALL
from tests.llm.test_near_duplicates import brute


def test_stages(spark, tmp_path):
    labels, docs = table(spark, SMALL, "labels"), table(spark, SMALL, "documents")
    kinds = docs.schema
    kept, last = {}, None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / name))
        last, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert [f.name for f in docs.schema] == [f.name for f in kinds]
        kept[name] = (last, docs)
    before, after = kept["quality"]
    good = crf_quality.score(before, crf_quality.fit(before, labels)).filter("predicted = 1")
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in good.collect()}
    before, after = kept["toxicity"]
    clean = ordinal_toxicity.grade(before, ordinal_toxicity.fit(before, labels)).filter("predicted = 0")
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in clean.collect()}
    before, after = kept["near_duplicates"]
    rows = before.orderBy("doc_id").collect()
    first = {}
    for r, c in zip(rows, brute([r["text"] for r in rows])):
        first.setdefault((c, r["doc_id"] if not (r["text"] or "").split() else None), r["doc_id"])
    assert {r["doc_id"] for r in after.collect()} == set(first.values())
    before, after = kept["personal_data"]
    assert before.count() == after.count()
    assert pii.personal_data(after).filter("n_email + n_ip + n_card + n_phone > 0").count() == 0
    before, after = kept["packing"]
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()}


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{n}" for n in range(1, 14)}


def test_fitted_stages_on_odd_documents(spark, odd_docs, tmp_path):
    """Odd rows among the given ones, whose labels fit both classifiers: every decision is that of the operator."""
    given = table(spark, SMALL, "documents")
    docs = given.unionByName(odd_docs.select((odd_docs["doc_id"] + 10 ** 7).alias("doc_id"), *given.columns[1:]))
    labels = table(spark, SMALL, "labels")
    field = crf_quality.fit(docs, labels)
    assert field.weights is not None

    def ids(rows):
        return Counter(r["doc_id"] for r in rows.select("doc_id").collect())

    good = ids(crf_quality.score(docs, field).filter("predicted = 1"))
    stages, out = dict(corpus_pipeline.STAGES), {}
    for name in ("quality", "toxicity", "near_duplicates", "personal_data"):
        stages[name](spark, docs, SMALL).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        assert docs.schema.names == given.schema.names
        out[name] = ids(docs)
        if name == "toxicity":
            refitted = ordinal_toxicity.fit(before, labels)  # each stage learns from its own input
            assert refitted is not None and out[name] == ids(ordinal_toxicity.grade(before, refitted).filter("predicted = 0"))
    assert out["quality"] == good and sum(n for i, n in good.items() if i is None or i > 10 ** 7) > 0
    assert out["personal_data"] == out["near_duplicates"] and not out["near_duplicates"] - out["toxicity"]
    packed = stages["packing"](spark, docs, SMALL)
    assert set(ids(packed)) == set(out["personal_data"]) and packed.agg({"length": "sum"}).first()[0] > 0


def test_stages_on_odd_documents(spark, odd_docs, no_docs, tmp_path):
    (labels := spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame((out := stage(spark, docs, str(tmp_path))).collect(), out.schema)
    assert labels.count() == 1
