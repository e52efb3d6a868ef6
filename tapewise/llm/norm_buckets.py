"""Exact top-k inner products by buckets of vector length, with coordinate or length pruning inside a bucket."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewise.llm.common import filesystem, tasks
from tapewise.sources import staging

SCALE = 256
K = 5
EVERY = 50
#: Vectors of similar length in a bucket, and those a task holds at a time.
BUCKET = 1024
HELD = 65_536
#: About so many of the longest vectors meet every query first, which gives it a lower bound of its k-th score.
FIRST = 4096
#: Above this cosine a bucket's vectors are found by their values in one coordinate, below by length alone.
FOCUS = 0.7


def finite(vector: str) -> Column:
    """Whether a vector is there, has components, and all are finite numbers."""
    good = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & good


def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component, for rows with a vec_id and a finite vector; and its length.

    A component beyond 64 bits raises.
    """
    def whole(x: Column) -> Column:
        scaled = F.lit(scale) * x.cast("double")
        return F.when(F.abs(scaled) < 2.0 ** 63, F.floor(scaled).cast("long")).otherwise(F.raise_error(F.lit("a component beyond 64 bits")).cast("long"))

    v = F.transform("embedding", whole)
    rows = embeddings.filter(F.col("vec_id").isNotNull() & finite("embedding")).select(F.col("vec_id").cast("long"), v.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, width)


def _of_width(batch: pa.RecordBatch) -> dict[int, pa.RecordBatch]:
    sizes = np.diff(batch.column("v").offsets.to_numpy())
    return {int(w): batch.filter(pa.array(sizes == w)) for w in np.unique(sizes)}


def products(vectors: np.ndarray, query: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of whole numbers kept as doubles; ``most`` bounds their sizes, those of all partial sums too.

    Doubles hold them below 2^53, 64-bit integers below 2^63; beyond, Python's integers are asked, and a product
    that does not fit into 64 bits raises.
    """
    if most < 2.0 ** 52:
        return vectors @ query
    if most < 2.0 ** 62:
        return vectors.astype(np.int64) @ query.astype(np.int64)
    own = [int(x) for x in query]
    return np.array([sum(int(a) * b for a, b in zip(row, own)) for row in vectors.tolist()], dtype=np.int64)


def _not_above(score: float) -> float:
    """A double that is no larger than the whole number that was rounded to ``score``."""
    return float(score) if abs(score) < 2.0 ** 53 else float(np.nextafter(float(score), -np.inf))


def query_blocks(folder: str, longest: float = np.inf) -> Iterator[pa.RecordBatch]:
    """The queries in blocks, streamed from the files that Spark wrote to the shared folder.

    Row groups whose queries all need vectors longer than ``longest`` are left out, by the statistics of ``ratio``.
    """
    fs, path = filesystem(folder)
    from pyarrow.fs import FileSelector

    for info in sorted(fs.get_file_info(FileSelector(path)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as source:
                parquet = pq.ParquetFile(source)
                groups = [g for g in range(parquet.num_row_groups) if _least_ratio(parquet.metadata.row_group(g)) <= longest * (1 + 1e-9)]
                yield from parquet.iter_batches(batch_size=2048, row_groups=groups) if groups else ()


def _least_ratio(group: pq.RowGroupMetaData) -> float:
    for c in range(group.num_columns):
        column = group.column(c)
        if column.path_in_schema == "ratio" and column.statistics is not None and column.statistics.has_min_max:
            return column.statistics.min
    return -np.inf


def _in_bucket(vectors: np.ndarray, norms: np.ndarray, order: tuple[np.ndarray, np.ndarray], query: np.ndarray, length: float, least: float) -> np.ndarray:
    """Rows of a bucket (by falling length) whose product with the query can reach ``least``."""
    if not length or least <= -np.inf:
        return np.arange(len(norms))
    cosine = least / (length * norms[0]) if norms[0] else (1.0 if least > 0 else -1.0)
    if cosine > 1 + 1e-12:
        return np.zeros(0, np.int64)
    if cosine < FOCUS:  # by length: beyond some row all are too short
        return np.arange(len(norms) if least <= 0 else np.searchsorted(-norms, -least / length * (1 - 1e-12), "right"))
    unit = query / length
    f = int(np.argmax(np.abs(unit)))
    # cos(a + b) and cos(a - b) bound the focus coordinate of unit vectors within the angle of the query.
    angle, own = np.arccos(min(1.0, cosine)), np.arccos(np.clip(unit[f], -1, 1))
    low = np.cos(min(np.pi, own + angle)) - 1e-9
    high = np.cos(max(0.0, own - angle)) + 1e-9
    rows, values = order[0][f], order[1][f]
    return rows[np.searchsorted(values, low, "left"):np.searchsorted(values, high, "right")]


def _search(batches: Iterator[pa.RecordBatch], folder: str, k: int) -> Iterator[pa.RecordBatch]:
    for batch in _held(batches):
        for width, rows in _of_width(batch).items():
            ids, all_norms = rows.column("vec_id").to_numpy(), rows.column("norm").to_numpy()
            by_length = np.lexsort((ids, -all_norms))
            ids, all_norms, vectors = ids[by_length], all_norms[by_length], _matrix(rows.column("v"), width)[by_length]
            buckets = []
            for start in range(0, len(ids), BUCKET):
                part = slice(start, start + BUCKET)
                with np.errstate(invalid="ignore", divide="ignore"):
                    unit = np.nan_to_num(vectors[part] / all_norms[part, None])
                order = np.argsort(unit, axis=0).T
                buckets.append((vectors[part], all_norms[part], ids[part], (order, np.take_along_axis(unit.T, order, axis=1))))
            for queries in query_blocks(folder, float(all_norms[0])):
                for q_width, own in _of_width(queries).items():
                    if q_width == width:
                        yield from _search_block(buckets, own, width, k)


def _search_block(buckets: list, queries: pa.RecordBatch, width: int, k: int) -> Iterator[pa.RecordBatch]:
    q, q_ids, lengths = _matrix(queries.column("v"), width), queries.column("vec_id").to_numpy(), queries.column("norm").to_numpy()
    least = queries.column("least").to_numpy(zero_copy_only=False).astype(float)
    least = np.where(np.isnan(least), -np.inf, least)
    got_q, got_v, got_s = [], [], []
    for n in range(len(q)):
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        bound = _not_above(least[n])
        for vectors, norms, ids, order in buckets:
            rows = _in_bucket(vectors, norms, order, q[n], lengths[n], bound)
            if not len(rows):
                continue
            if len(rows) == len(vectors):
                rows, own = np.arange(len(rows)), vectors  # all of them, in their own order
            else:
                own = vectors[rows]
            scores = products(own, q[n], lengths[n] * norms[0])
            keep = (scores >= bound) & (ids[rows] != q_ids[n])
            best_ids, best = np.concatenate([best_ids, ids[rows][keep]]), np.concatenate([best, scores[keep].astype(np.int64)])
            if len(best) > k:
                top = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[top], best[top]
                bound = max(bound, _not_above(best[-1]))
        got_q.append(np.full(len(best), q_ids[n]))
        got_v.append(best_ids)
        got_s.append(best)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got_q)), pa.array(np.concatenate(got_v)), pa.array(np.concatenate(got_s))],
                                     names=["query_id", "vec_id", "score"])


def _held(batches: Iterator[pa.RecordBatch], rows: int = HELD) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``rows`` rows, so that the queries are read once for each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held and (whole := pa.Table.from_batches(held).combine_chunks()).num_rows:
        yield whole.to_batches()[0]


def top(found: DataFrame, k: int, *more: str) -> DataFrame:
    """The k highest scores of each query, ties to the smaller vec_id, numbered from 1; with ``more`` columns."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *more)


def _about(vectors: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` of the longest vectors, at most; of more that are equally long a part by hash."""
    n = vectors.count()
    if n <= rows:
        return vectors
    long = vectors.filter(F.col("norm") >= vectors.agg(F.percentile_approx("norm", 1 - rows / n, 10_000)).first()[0])
    return long.filter(F.pmod(F.xxhash64("vec_id"), F.lit(-(-long.count() // rows))) == 0)


def top_products(embeddings: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products of integer vectors with other rows.

    Queries are the rows whose vec_id is divisible by ``every``. Vectors that are null, empty or hold null or
    non-finite components, and rows without vec_id, take no part; vectors of another width are never
    compared; a query's own vec_id is no candidate, so repeated rows of it are none either. Fewer
    candidates than k give fewer rows; no rows give none.

    Vectors lie by falling length over the tasks, each with buckets of similar length. Queries are written
    once and streamed by every task in blocks; the longest vectors first give each query a lower bound of
    its k-th score. Inside a bucket the bound becomes a cosine: a large one leaves a range of values of the
    query's largest coordinate, a small one leaves the vectors that are long enough. What is left is verified
    by exact products, in integers where doubles would round; a product beyond 64 bits raises.
    """
    spark: SparkSession = embeddings.sparkSession
    vectors = integer_vectors(embeddings, scale)
    folder = staging.new_path(spark, "queries")
    queries = staging.written(vectors.filter(F.col("vec_id") % every == 0).withColumn("least", F.lit(None).cast("double")), "queries-first")
    queries.write.parquet(f"{folder}/first")
    kinds = "query_id long, vec_id long, score long"
    longest = _about(vectors, FIRST)
    bound = top(longest.mapInArrow(partial(_search, folder=f"{folder}/first", k=k), kinds), k)
    bound = bound.filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("known"))
    bounded = queries.join(bound, queries["vec_id"] == bound["query_id"], "left").select("vec_id", "v", "norm", F.col("known").alias("least"))
    # Where even the bound needs a longer vector than a task has, its queries are skipped by the row group.
    ratio = F.coalesce(F.when(F.col("norm") > 0, F.col("least") / F.col("norm")), F.lit(float("-inf")))
    ordered = bounded.withColumn("ratio", ratio).repartitionByRange("ratio").sortWithinPartitions("ratio")
    ordered.write.option("parquet.block.size", 1 << 20).parquet(f"{folder}/bounded")
    spread = vectors.repartitionByRange(tasks(spark), F.desc("norm"), "vec_id")
    return top(spread.mapInArrow(partial(_search, folder=f"{folder}/bounded", k=k), kinds), k)
