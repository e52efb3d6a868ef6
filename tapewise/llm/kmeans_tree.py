"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first, as widely as calibration asks."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewise.llm.norm_buckets import finite, top
from tapewise.sources import staging

K = 5
EVERY = 50
#: Vectors that the tree is fitted on, at most about; all vectors are indexed.
SAMPLE = 32_768
BRANCHES = 16
#: Least vectors of the sample in a leaf; leaves are as large as the square root of all vectors asks.
LEAF = 16
#: Queries that are searched exactly to calibrate, at most about, and the share of neighbours the tree must find for them.
CALIBRATION = 256
RECALL = 0.95
#: Vectors of a leaf that meet its queries in one task.
PART = 2048
ROUNDS = 8


class Tree:
    """Nodes of a k-means tree over unit vectors: an inner node has its children's centres, a leaf a number."""

    def __init__(self, centres: list[np.ndarray], children: list[list[int]], leaf: list[int], leaves: int):
        self.centres, self.children, self.leaf, self.leaves = centres, children, leaf, leaves

    @classmethod
    def fit(cls, unit: np.ndarray, branches: int = BRANCHES, leaf_size: int = LEAF, seed: int = 0) -> Tree:
        rng = np.random.default_rng(seed)
        tree = cls([], [], [], 0)

        def grow(rows: np.ndarray) -> int:
            node = len(tree.leaf)
            tree.centres.append(np.zeros((0, unit.shape[1])))
            tree.children.append([])
            tree.leaf.append(-1)
            own = cls._split(unit[rows], min(branches, -(-len(rows) // leaf_size)), rng) if len(rows) > leaf_size else None
            if own is None or len(np.unique(own[1])) < 2:
                tree.leaf[node] = tree.leaves
                tree.leaves += 1
                return node
            used = np.unique(own[1])
            tree.centres[node] = own[0][used]
            tree.children[node] = [grow(rows[own[1] == c]) for c in used]
            return node

        grow(np.arange(len(unit)))
        return tree

    @staticmethod
    def _split(x: np.ndarray, branches: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        centres = x[rng.choice(len(x), min(branches, len(x)), replace=False)].copy()
        for _ in range(ROUNDS):
            nearest = np.argmax(x @ centres.T - (centres ** 2).sum(axis=1) / 2, axis=1)
            for c in np.unique(nearest):
                centres[c] = x[nearest == c].mean(axis=0)
        return centres, np.argmax(x @ centres.T - (centres ** 2).sum(axis=1) / 2, axis=1)

    def assign(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child at every node."""
        out = np.zeros(len(unit), np.int64)
        todo = [(0, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            centres = self.centres[node]
            # One centre at a time in a fixed order: equal vectors get the same leaf wherever they lie in a batch.
            far = np.stack([((unit[rows] - c) ** 2).sum(axis=1) for c in centres], axis=1)
            nearest = np.argmin(far, axis=1)
            todo += [(self.children[node][c], rows[nearest == c]) for c in np.unique(nearest)]
        return out

    def visit(self, query: np.ndarray, leaves: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first ``leaves`` leaves of a best-bin-first traversal: the nearest node seen so far is opened next.

        With the ``sizes`` of the leaves it goes on until those found hold ``least`` vectors.
        """
        queue, seen, found, held = [(0.0, 0, 0)], 0, [], 0
        while queue and (len(found) < leaves or sizes is not None and held < least):
            _, _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                found.append(self.leaf[node])
                held += int(sizes[self.leaf[node]]) if sizes is not None else 0
                continue
            for far, child in zip(((self.centres[node] - query) ** 2).sum(axis=1).tolist(), self.children[node]):
                seen += 1
                heapq.heappush(queue, (far, seen, child))
        return found


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of rows with an id and a finite vector other than zero."""
    rows = embeddings.filter(F.col("vec_id").isNotNull() & finite("embedding") & F.exists("embedding", lambda x: x != 0))
    return rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))


def _rows(batch: pa.RecordBatch, width: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows of vectors of one width, and these as a matrix."""
    fits = np.diff(batch.column("v").offsets.to_numpy()) == width
    batch = batch if fits.all() else batch.filter(pa.array(fits))
    return batch, batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    return scaled / np.sqrt((scaled ** 2).sum(axis=1, keepdims=True))


def _scaled(x: np.ndarray) -> np.ndarray:
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def cosines(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosine of each row with the query in double precision, by the same sums wherever a row lies.

    Vectors are scaled by powers of two first, which changes no digit but keeps very large and small squares in range.
    """
    x, query = _scaled(x), _scaled(query[None, :])[0]
    return (x * query).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((query * query).sum()))


def _best(ids: np.ndarray, x: np.ndarray, query_id: int, query: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    own = ids != query_id
    if own.sum() > k:
        own &= rough >= np.partition(rough[own], -k)[-k] - 1e-9
    near = np.flatnonzero(own)
    score = cosines(x[near], query)
    order = np.lexsort((ids[near], -score))[:k]
    return near[order], score[order]


def _out(rows: list[tuple], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    if rows:
        kinds = {"score": pa.float64(), "leaf": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, zip(*rows))], names=list(names))


def _exactly(batches: Iterator[pa.RecordBatch], tree: Tree, ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch, x = _rows(batch, queries.shape[1])
        if not len(x):
            continue
        unit = _unit(x)
        rough, own, leaves, found = _unit(queries) @ unit.T, batch.column("vec_id").to_numpy(), tree.assign(unit), []
        for n, query_id in enumerate(ids.tolist()):
            near, score = _best(own, x, query_id, queries[n], rough[n], k)
            found += [(query_id, int(own[r]), float(s), int(leaves[r])) for r, s in zip(near, score)]
        yield from _out(found, ("query_id", "vec_id", "score", "leaf"))


def _assigned(batches: Iterator[pa.RecordBatch], tree: Tree, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch, x = _rows(batch, width)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(tree.assign(_unit(x)))], names=["vec_id", "v", "leaf"])


def _visits(batches: Iterator[pa.RecordBatch], tree: Tree, width: int, leaves: int, sizes: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The leaves of each query, with at least k vectors besides the rows of its own vec_id, wherever those lie."""
    for batch in batches:
        batch, x = _rows(batch, width)
        visits = pa.array([tree.visit(q, leaves, sizes, k + own) for q, own in zip(_unit(x), batch.column("own").to_pylist())], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), visits], names=["vec_id", "v", "visits"])


def _meet(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """Queries against the vectors of their leaf's part; rows come part by part, the vectors before the queries."""
    group, ids, held, x, unit, found = None, [], [], None, None, []
    for batch in batches:
        batch, rows = _rows(batch, width)
        for leaf, part, asks, vec_id, v in zip(*(batch.column(n).to_pylist() for n in ("leaf", "part", "asks", "vec_id")), rows):
            if (leaf, part) != group:
                group, ids, held, x = (leaf, part), [], [], None
            if not asks:
                ids.append(vec_id)
                held.append(v)
                continue
            if not ids:
                continue
            if x is None:
                x, own = np.array(held), np.array(ids)
                unit = _unit(x)
            near, score = _best(own, x, vec_id, v, unit @ _unit(v[None, :])[0], k)
            found += [(vec_id, int(own[r]), float(s)) for r, s in zip(near, score)]
        yield from _out(found, ("query_id", "vec_id", "score"))
        found = []


def _sample(rows: DataFrame, n: int, most: int) -> DataFrame:
    """About ``most`` rows at most, by a hash of their id."""
    return rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(-(-n // most))) == 0) if n > most else rows


def _matrix(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    got = rows.filter(F.size("v") == width).orderBy("vec_id").toArrow().combine_chunks()
    flat = got.column("v").combine_chunks()
    return got.column("vec_id").to_numpy(), flat.flatten().to_numpy().reshape(-1, width)


def nearest(embeddings: DataFrame, k: int = K, every: int = EVERY, recall: float = RECALL, branches: int = BRANCHES,
            leaf_size: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k nearest found by cosine, ties to the smaller vec_id.

    Also recall: the share of the calibration queries' neighbours that lie in the leaves visited, of vectors of this width.

    Queries are rows whose vec_id is divisible by ``every``; rows with the query's own vec_id are no
    candidates. Vectors that are null, zero or hold null or non-finite components, and rows without vec_id,
    take no part. Vectors of each width are searched among their own, by a tree of their own. Fewer candidates
    give fewer rows; no usable rows give none.

    The tree is fitted on at most about SAMPLE vectors, with about as many leaves as the square root of all
    vectors as long as the sample suffices for it; every vector is indexed under its leaf. About
    CALIBRATION queries are searched exactly. Their neighbours' leaves show how many leaves a best-bin-first
    traversal must visit until ``recall`` of the neighbours is found; all queries visit so many, and more
    where these hold fewer than k candidates. A leaf that
    holds many vectors is cut into parts of about PART, each of which meets the leaf's queries.
    """
    spark = embeddings.sparkSession
    vectors = usable(embeddings)
    asks = F.max((F.col("vec_id") % every == 0).cast("int"))
    widths = vectors.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), asks.alias("asks")).filter("asks = 1").orderBy("width").collect()
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, recall double")
    if len(widths) > 1:
        vectors = staging.written(vectors, "usable")
    found = [_found(vectors.filter(F.size("v") == r["width"]), r["n"], r["width"], k, every, recall, branches, leaf_size) for r in widths]
    return top(reduce(DataFrame.unionByName, found), k, "recall")


def _found(vectors: DataFrame, n: int, width: int, k: int, every: int, recall: float, branches: int, leaf_size: int | None) -> DataFrame:
    """query_id, vec_id, score: the k nearest found in each part of a visited leaf, of ``n`` vectors of one width."""
    kinds = "query_id long, vec_id long, score double"
    sample = _unit(_matrix(_sample(vectors, n, SAMPLE), width)[1])
    tree = Tree.fit(sample, branches, leaf_size or max(LEAF, round(len(sample) / n ** 0.5)))
    queries = vectors.filter(F.col("vec_id") % every == 0)
    # Of several rows of one id the least vector asks.
    single = queries.groupBy("vec_id").agg(F.min("v").alias("v"), F.count("*").alias("own"))
    ids, asked = _matrix(_sample(single, max(1, queries.count()), CALIBRATION), width)
    leaves, reached = 1, 1.0
    if len(ids):
        exact = top_with_leaf(vectors.mapInArrow(partial(_exactly, tree=tree, ids=ids, queries=asked, k=k), kinds + ", leaf long"), k)
        place = {q: {leaf: at for at, leaf in enumerate(tree.visit(v, tree.leaves))} for q, v in zip(ids.tolist(), _unit(asked))}
        needed = sorted(place[r["query_id"]][r["leaf"]] + 1 for r in exact.select("query_id", "leaf").collect())  # k rows for each of CALIBRATION
        leaves = needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else 1
        reached = float(np.mean(np.array(needed) <= leaves)) if needed else 1.0
    indexed = staging.written(vectors.mapInArrow(partial(_assigned, tree=tree, width=width), "vec_id long, v array<double>, leaf long"), "leaves")
    sizes = np.zeros(tree.leaves, np.int64)
    for r in indexed.groupBy("leaf").count().collect():  # a row per leaf, at most one for each vector of the sample
        sizes[r["leaf"]] = r["count"]
    parts = indexed.groupBy("leaf").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    visits = single.mapInArrow(partial(_visits, tree=tree, width=width, leaves=leaves, sizes=sizes, k=k), "vec_id long, v array<double>, visits array<long>")
    parts = F.broadcast(parts)  # a row per leaf, at most one for each vector of the sample
    asking = (visits.select("vec_id", "v", F.explode("visits").alias("leaf")).join(parts, "leaf")
              .select("leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "vec_id", "v"))
    lying = indexed.join(parts, "leaf").select("leaf", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("asks"), "vec_id", "v")
    meet = lying.unionByName(asking).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "asks")
    return meet.mapInArrow(partial(_meet, width=width, k=k), kinds).withColumn("recall", F.lit(reached))


def top_with_leaf(found: DataFrame, k: int) -> DataFrame:
    leaf = found.select("query_id", "vec_id", "leaf").distinct()
    return top(found.select("query_id", "vec_id", "score"), k).join(leaf, ["query_id", "vec_id"])
