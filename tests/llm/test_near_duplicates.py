import random
from collections import Counter
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from tapewise.llm import dart_minhash as dm
from tapewise.llm.common import table
from tests.conftest import SMALL


def bag(text):
    words = (text or "").lower().split()
    return Counter(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))) if words else None


def brute(texts):
    """The class of each text: connected by a weighted Jaccard similarity of 0.8 or more of 5-word shingles."""
    bags = [bag(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = set()
    inverse = {}
    for n, b in enumerate(bags):
        for s in b or ():
            inverse.setdefault(s, []).append(n)
    for rows in inverse.values():
        near.update(combinations(rows, 2))
    for x, y in near:
        a, b = bags[x], bags[y]
        both = sum((a & b).values())
        if both >= 0.8 * (sum(a.values()) + sum(b.values()) - both) - 1e-9:
            x, y = sorted((root(x), root(y)))
            parent[y] = x
    return [root(n) for n in range(len(texts))]


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(edits):
            words[rng.randrange(len(words))] = "w%d" % rng.randrange(10 ** 6)
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    prose = lambda n: " ".join("v%d" % rng.randrange(5000) for _ in range(n))
    hot = prose(300)
    passage = prose(60)
    return (family(rng, hot, 150, 4) + family(rng, prose(120), 8, 1) + [prose(200) for _ in range(60)] + [passage + " " + prose(40) for _ in range(40)]
            + ["a b", "A  b", "a b c", "", None, " ", "same line\n" * 400, "same line\n" * 380, "same line\n" * 100])


def test_classes_equal_brute_force(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = brute(texts)
    least = {}
    for n, c in enumerate(want):
        least.setdefault(c, n)
    got = dict(map(tuple, dm.near_duplicates(docs).collect()))
    assert got == {n: least[c] for n, c in enumerate(want)}


def test_parts_of_a_bucket_lose_no_link(spark, texts, monkeypatch):
    monkeypatch.setattr(dm, "PART", 8)
    monkeypatch.setattr(dm, "LEAD_PARTS", 2)
    test_classes_equal_brute_force(spark, texts[:170])
    monkeypatch.setattr(dm, "PART_SHINGLES", 700)
    test_classes_equal_brute_force(spark, texts[:170])


def test_a_row_meets_one_text_at_most(spark):
    """Null and repeated ids: as many rows pass the join with the texts as there are rows."""
    words = ["w%d" % k for k in range(400)]
    rng = random.Random(8)
    texts = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(200)]
    texts += [t + " x" for t in texts]
    rows = [(None, t) for t in texts for _ in range(4)] + [(7, t) for t in texts[:100] for _ in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sizes = []

    def spy(batches, words):
        for batch in batches:
            yield from [pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])]

    whole = DataFrame.mapInArrow

    def counted(df, f, schema, *rest):
        if getattr(f, "func", None) is dm._contents:
            sizes.append(whole(df, partial(spy, words=5), "n long").agg({"n": "sum"}).first()[0])
        return whole(df, f, schema, *rest)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(docs), "mapInArrow", counted)
        classes = dm.near_duplicates(docs).collect()
    assert len(classes) == 2000 and sizes and 400 <= sizes[0] <= 2000


def test_few_exchanges(spark, odd_docs, monkeypatch):
    """Written tables of a run on rows without large buckets: each step is planned once, no loop of small jobs."""
    names = []
    plain = dm.staging.written
    monkeypatch.setattr(dm.staging, "written", lambda df, name: names.append(
        (name, df._jdf.queryExecution().executedPlan().toString().count("Exchange "))) or plain(df, name))
    dm.near_duplicates(odd_docs).count()
    assert len(names) <= 10 and sum(n for _, n in names) <= 60, names


def test_classes_on_the_given_table(spark):
    rows = table(spark, SMALL, "documents").select("doc_id", "text").collect()
    want = brute([r["text"] for r in rows])
    groups = {}
    for r, c in zip(rows, want):
        groups.setdefault(c, []).append(r["doc_id"])
    want = {i: min(g) for g in groups.values() for i in g}
    assert dict(map(tuple, dm.near_duplicates(table(spark, SMALL, "documents")).collect())) == want


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    got = Counter(map(tuple, dm.near_duplicates(odd_docs).collect()))
    assert sum(got.values()) == len(odd_rows)
    assert got[3, 2] == 1 and got[2, 2] == 2 and got[None, 4] == 2  # equal texts: the smallest id
    assert got[5, 5] == got[6, 6] == got[7, 7] == 1 and got[None, None] == 1  # no words: alone
    assert dm.near_duplicates(no_docs).count() == 0


def test_keep_one_keeps_columns_and_one_row_of_each_class(spark, odd_docs, no_docs):
    kept = dm.keep_one(odd_docs)
    assert kept.schema == odd_docs.schema
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter([1, 2, 4, None, 5, 6, 7, 8, 9, 10, 11, 12, 13, 9_000_000_000])
    assert dm.keep_one(no_docs).count() == 0


def test_keep_one_keeps_every_text_without_words(spark):
    rows = [(None, None, "en"), (None, None, "de"), (None, "", "fr"), (None, " ", "it"), (3, "", "en"), (3, "", "de"),
            (None, "some words", "en"), (None, "some words", "de"), (4, "more", "en"), (4, "more", "de")]
    kept = dm.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    assert Counter(map(tuple, kept))[None, None, "de"] == 1
    assert sorted(r["lang"] for r in kept if not (r["text"] or "").strip()) == ["de", "de", "en", "en", "fr", "it"]
    assert sorted(r["text"] for r in kept if (r["text"] or "").strip()) == ["more", "some words"]


def test_agreement_is_the_weighted_jaccard_similarity():
    rng = np.random.default_rng(0)
    element = rng.integers(1, 2 ** 62, 60).astype(np.uint64)
    x, y = rng.gamma(0.5, 4, 60), rng.gamma(0.5, 4, 60)
    of, both = np.repeat([0, 1], 60), np.concatenate([element, element])
    s = dm.signatures(of, both, np.concatenate([x, y]), 3, 4000)
    truth = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert abs((s[0] == s[1]).mean() - truth) < 0.04
    assert (s[2] == 0).all()


def test_word_hashes_follow_the_words():
    from tapewise.llm.hashing import word_hashes

    texts = ["One two\none", "", "  ", "two", "É é"]
    hashes, per_text = word_hashes(texts)
    assert per_text.tolist() == [3, 0, 0, 1, 2]
    assert hashes[0] == hashes[2] != hashes[1] == hashes[3] and hashes[4] == hashes[5]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = dict(map(tuple, dm.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 140)}}
