import numpy as np
import pytest

from tapewise.llm import kmeans_tree, norm_buckets
from tapewise.llm.common import table
from tests.conftest import SMALL


def plain(rows, score, k=5, every=50):
    out = set()
    for q, v in rows:
        if q % every == 0:
            found = sorted(((-score(v, w), c) for c, w in rows if c != q))[:k]
            out |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(found)}
    return out


@pytest.fixture(scope="module")
def mixed(spark):
    """Lengths that differ, equal vectors and ties, and rows that take no part."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.01, 1, 30])).tolist()) for i in range(700)]
    rows += [(i, [0.5] * 8) for i in range(700, 900)] + [(i, [-1.0] * 8) for i in range(900, 920)]
    good = [(i, np.asarray(v, np.float32).astype(float)) for i, v in rows]
    odd = [(2000, None), (2050, [None] * 8), (2100, [float("nan")] * 8), (2150, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (2200, [])]
    df = spark.createDataFrame([(i, v, 1, 2, 3.0) for i, v in rows + odd], "vec_id long, embedding array<float>, label int, rank int, score double")
    return good, df.repartition(4)


def test_products_equal_brute_force(spark, mixed, monkeypatch):
    good, df = mixed
    whole = [(i, np.floor(256 * v).astype(np.int64)) for i, v in good] 
    want = plain(whole, lambda a, b: int(a @ b))
    for bucket, focus, first in ((64, 0.0, 50), (1024, 0.7, 4096), (16, 0.99, 10)):
        monkeypatch.setattr(norm_buckets, "BUCKET", bucket)
        monkeypatch.setattr(norm_buckets, "FOCUS", focus)
        monkeypatch.setattr(norm_buckets, "FIRST", first)
        got = {tuple(r) for r in norm_buckets.top_products(df).collect() if r["query_id"] < 2000}
        assert got == want


def test_pruning_leaves_few_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    order = np.argsort(x, axis=0).T
    sorted_ = (order, np.take_along_axis(x.T, order, axis=1))
    q = x[0]
    rows = norm_buckets._in_bucket(x, np.ones(1000), sorted_, q, 1.0, 0.95)
    assert 0 in rows and set(np.flatnonzero(x @ q >= 0.95)) <= set(rows) and len(rows) < 300
    assert len(norm_buckets._in_bucket(x, np.ones(1000), sorted_, q, 1.0, 1.5)) == 0


def test_tree_search_reaches_recall_and_exact_scores(spark, mixed):
    good, df = mixed
    want = plain([(i, v) for i, v in good if np.abs(v).max() > 0], lambda a, b: round(float(a @ b) / np.sqrt(float(a @ a) * float(b @ b)), 12))
    got = kmeans_tree.nearest(df).filter("query_id < 2000").collect()
    known = {(q, c): s for q, _, c, s in want}
    hit = [r for r in got if (r["query_id"], r["vec_id"]) in known]
    assert len(hit) >= 0.9 * len(want) and {r["recall"] >= kmeans_tree.RECALL for r in got} == {True}
    for r in hit:
        assert abs(r["score"] - known[r["query_id"], r["vec_id"]]) < 1e-9
    assert all(r["vec_id"] < 900 for r in got if r["query_id"] in range(700, 900))
    ties = [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 850]
    assert ties == [700, 701, 702, 703, 704]  # equal vectors: the smaller ids


def test_tree_recall_on_the_given_table(spark):
    rows = [(r["vec_id"], np.asarray(r["embedding"], float)) for r in table(spark, SMALL, "embeddings").collect()]
    want = {(q, c) for q, _, c, _ in plain(rows, lambda a, b: float(a @ b) / np.sqrt(float(a @ a) * float(b @ b)), every=5)}
    got = {(r["query_id"], r["vec_id"]) for r in kmeans_tree.nearest(table(spark, SMALL, "embeddings"), every=5).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_tree_recall_on_two_thousand_vectors(spark):
    rows = {r["vec_id"]: np.asarray(r["embedding"], float) for r in table(spark, "/root/testdata/sf0.1", "embeddings").collect()}
    ids, unit = np.array(list(rows)), np.stack([v / np.sqrt(v @ v) for v in rows.values()])
    got, want = kmeans_tree.nearest(table(spark, "/root/testdata/sf0.1", "embeddings")).collect(), set()
    for q in np.flatnonzero(ids % 50 == 0):
        score = np.where(ids == ids[q], -2, unit @ unit[q])
        want |= {(int(ids[q]), int(c)) for c in ids[np.lexsort((ids, -score))[:5]]}
    assert len(rows) == 2000 and len(want & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.9 * len(want)


def test_cosines_of_extreme_vectors():
    x, q = np.array([[3.0, 4.0], [1.0, 0.0]]), np.array([4.0, 3.0])
    plain_ = (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))
    for a, b in ((1.0, 1.0), (1e200, 1e-200), (1e-200, 1e200), (1e300, 1e300)):
        np.testing.assert_allclose(kmeans_tree.cosines(x * a, q * b), plain_, rtol=1e-15)
    assert (kmeans_tree.cosines(x, q) == plain_).all()


def test_the_least_of_several_query_vectors_asks(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.9, 0.1]), (2, [0.1, 0.9])]
    for order in (rows, rows[::-1]):
        got = kmeans_tree.nearest(spark.createDataFrame(order, "vec_id long, embedding array<double>").repartition(2)).collect()
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [2, 1]


def test_products_of_large_vectors_are_exact(spark):
    rng = np.random.default_rng(3)
    for low, high in ((1e5, 3e5), (6e5, 9e5)):
        rows = [(i, np.round(rng.uniform(low, high, 64), 3).tolist()) for i in range(0, 60)]
        whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
        want = plain(whole, lambda a, b: sum(x * y for x, y in zip(a, b)), every=10)
        got = norm_buckets.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10).collect()
        assert {tuple(r) for r in got} == want
    assert norm_buckets.products(np.array([[2.0 ** 31, -1.0]]), np.array([2.0 ** 32, 1.0]), 2.0 ** 63.1).tolist() == [2 ** 63 - 1]
    with pytest.raises(Exception, match="64 bits"):
        norm_buckets.top_products(spark.createDataFrame([(0, [1e30])], "vec_id long, embedding array<double>")).collect()


def test_row_groups_of_queries_out_of_reach_are_skipped(tmp_path):
    pa, pq = pytest.importorskip("pyarrow"), pytest.importorskip("pyarrow.parquet")
    one = pa.table({"vec_id": list(range(6)), "ratio": [-np.inf, -np.inf, 1.0, 2.0, 5.0, 9.0]})
    pq.write_table(one, tmp_path / "q.parquet", row_group_size=2)
    seen = lambda longest: [i for b in norm_buckets.query_blocks(str(tmp_path), longest) for i in b.column("vec_id").to_pylist()]
    assert seen(0.5) == [0, 1] and seen(1.5) == [0, 1, 2, 3] and seen(np.inf) == list(range(6))


def test_best_bin_first_visits_every_leaf_in_the_end():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 6))
    tree = kmeans_tree.Tree.fit(x, branches=4, leaf_size=20)
    order = tree.visit(x[3], tree.leaves)
    assert sorted(order) == list(range(tree.leaves)) and tree.visit(x[3], 5) == order[:5]


def test_visited_leaves_hold_enough_candidates(spark):
    """Small leaves, and a calibration that asks for one of them: a query still gets k rows where there are k."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)] + [(0, [1.0, 2.0, 3.0, 4.0])] * 9
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = kmeans_tree.nearest(df, every=10, recall=0.01, leaf_size=2).collect()
    assert sorted((r["query_id"], r["rank"]) for r in got) == [(q, n) for q in range(0, 300, 10) for n in range(1, 6)]
    assert all(r["vec_id"] != r["query_id"] for r in got)
    few = kmeans_tree.nearest(df.filter("vec_id < 4"), every=10, recall=0.01, leaf_size=1).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3]


def test_vectors_of_every_width_are_searched(spark):
    rng = np.random.default_rng(9)
    rows = [(0, [1.0, 2.0])] + [(i, rng.normal(size=3 + i % 2).tolist()) for i in range(1, 200)]
    rows += [(i, [1.0]) for i in range(201, 205)]  # a width without a query
    got = kmeans_tree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10, recall=1.0).collect()
    width = {i: len(v) for i, v in rows}
    assert all(width[r["query_id"]] == width[r["vec_id"]] for r in got)
    assert {r["query_id"] for r in got} == set(range(10, 200, 10)) and len(got) == 5 * 19
    want = {(q, n, c) for w in (3, 4) for q, n, c, _ in plain([(i, np.array(v)) for i, v in rows if len(v) == w],
            lambda a, b: float(a @ b) / np.sqrt(float(a @ a) * float(b @ b)), every=10)}
    assert len(want & {(r["query_id"], r["rank"], r["vec_id"]) for r in got}) >= 0.9 * len(want)


def test_empty_and_unusable_tables(spark):
    kinds = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(50, None, 1), (100, [0.0, 0.0], 1)], [(50, [1.0, 0.0], 1)]):
        df = spark.createDataFrame(rows, kinds)
        assert kmeans_tree.nearest(df).count() == 0
    assert norm_buckets.top_products(spark.createDataFrame([], kinds)).count() == 0
    assert norm_buckets.top_products(spark.createDataFrame([(50, [1.0], 1)], kinds)).count() == 0
