"""Exact top-k inner products through a pivot-distance index.

With M the largest squared norm, a point x becomes (x, sqrt(M - |x|^2)) and a query q
becomes (q, 0); then |q - x|^2 = |q|^2 + M - 2 q.x, so the highest products are the nearest points.
Every point is keyed by its nearest pivot and the distance to it, and the table is
range-partitioned and sorted by that key.  A task cuts its rows into annuli (one pivot,
a range of distances).  For a query at distance d of the pivot no point of an annulus
[low, high] is nearer than max(d - high, low - d); annuli are visited from the nearest
bound outwards until no bound can reach the k-th best score.  Scores are integers and
exact; a bound only skips what lies strictly below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkloom.session import checkpointed

PIVOTS = 32
#: Rows that the pivots and the first bounds are chosen from (by a hash of the id); every row is indexed.
SAMPLE_ROWS = 2_048
#: Rows of one annulus, rows that a task holds at once, and queries that are broadcast at once.
ANNULUS = 512
HELD_ROWS = 32_768
QUERY_BLOCK = 4_096
_NONE = -(1 << 62)  # below every score


def quantized(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, vector): floor(256 * x) per component, without vectors that are null or hold null or non-finite values."""
    sound = F.forall(F.col(vector), lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return vectors.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & sound).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("vector"),
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer ``x @ y.T``: in doubles where every sum stays below 2**53, else in 64-bit integers."""
    if not x.size or not y.size:
        return np.zeros((len(x), len(y)), np.int64)
    if float(np.abs(x).max()) * float(np.abs(y).max()) * x.shape[1] < 2.0**53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T


def _distances(x: np.ndarray, pivots: np.ndarray, top: float) -> np.ndarray:
    """Distances of lifted points to lifted pivots."""
    lift = lambda v: np.sqrt(np.maximum(top - (v.astype(np.float64) ** 2).sum(axis=1), 0.0))
    inner = x.astype(np.float64) @ pivots.astype(np.float64).T + lift(x)[:, None] * lift(pivots)[None, :]
    return np.sqrt(np.maximum(2 * top - 2 * inner, 0.0))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first points of the sample."""
    chosen, away = [0], ((sample - sample[0]).astype(np.float64) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]).astype(np.float64) ** 2).sum(axis=1))
    return sample[chosen]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best per row: highest score, then smallest id."""
    return np.lexsort((ids, -scores), axis=1)[:, :k]


class _Search:
    """The queries of one block, their bounds, and the search of one run of sorted index rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray, pivots: np.ndarray, top: float, k: int):
        self.ids, self.vectors, self.floor, self.pivots, self.top, self.k = ids, vectors, floor, pivots, top, k
        squares = (vectors.astype(np.float64) ** 2).sum(axis=1)
        self.reach = squares + top  # |q|^2 + M
        self.to_pivot = np.sqrt(np.maximum(self.reach[:, None] - 2.0 * products(vectors, pivots), 0.0))

    def run(self, pivot: np.ndarray, distance: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> Iterator[tuple]:
        cut = np.unique(np.concatenate([np.arange(0, len(ids), ANNULUS), np.flatnonzero(np.diff(pivot)) + 1]))
        ends = np.append(cut[1:], len(ids))
        away = self.to_pivot[:, pivot[cut]]
        bound = np.maximum(0.0, np.maximum(away - distance[ends - 1], distance[cut] - away))
        ceiling = (self.reach[:, None] - bound**2) / 2 + 1e-6 * (1 + self.reach[:, None])  # no product of the annulus is higher
        best = np.full((len(self.ids), self.k), _NONE)
        best_id = np.full((len(self.ids), self.k), np.iinfo(np.int64).max)
        for place in np.argsort(-ceiling, axis=1, kind="stable").T:  # every query's next annulus
            least = np.maximum(best[:, -1], self.floor)
            open_ = np.flatnonzero(ceiling[np.arange(len(place)), place] >= least)
            if not len(open_):
                break
            for annulus in np.unique(place[open_]):
                rows = open_[place[open_] == annulus]
                some = slice(cut[annulus], ends[annulus])
                scores = products(self.vectors[rows], vectors[some])
                names = np.broadcast_to(ids[some], scores.shape)
                scores = np.where(names == self.ids[rows][:, None], _NONE, scores)
                scores, names = np.hstack([best[rows], scores]), np.hstack([best_id[rows], names])
                keep = _best(scores, names, self.k)
                best[rows], best_id[rows] = np.take_along_axis(scores, keep, 1), np.take_along_axis(names, keep, 1)
        found = (best > _NONE) & (best >= self.floor[:, None])
        row, column = np.nonzero(found)
        return self.ids[row], best_id[row, column], best[row, column]


FOUND = "query_id long, vec_id long, score long"


def _search_width(points: DataFrame, queries: DataFrame, width: int, k: int, pivot_count: int, query_block: int) -> DataFrame:
    spark = points.sparkSession
    sampled = points.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(SAMPLE_ROWS).toArrow()
    sample_ids = sampled.column("vec_id").to_numpy()
    sample = _matrix(sampled.column("vector").combine_chunks(), width)
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    top = float(points.agg(F.max(square)).first()[0])
    pivots = choose_pivots(sample, pivot_count)
    shared_pivots = spark.sparkContext.broadcast((pivots, top))  # at most PIVOTS vectors

    def place(column: pa.Array) -> pa.Array:
        centres, most = shared_pivots.value
        away = _distances(_matrix(column, width), centres, most)
        near = away.argmin(axis=1)
        return pa.StructArray.from_arrays(
            [pa.array(near.astype(np.int32)), pa.array(away[np.arange(len(near)), near])], ["pivot", "distance"]
        )

    key = F.arrow_udf(place, "struct<pivot int, distance double>")(F.col("vector"))
    index = points.select(key.alias("key"), "vec_id", "vector").select("key.pivot", "key.distance", "vec_id", "vector")
    order = ["pivot", "distance", "vec_id"]
    index = checkpointed(index.repartitionByRange(*order).sortWithinPartitions(*order))

    blocks = max(1, -(-queries.count() // query_block))
    found = None
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()  # about query_block rows
        ids, vectors = part.column("vec_id").to_numpy(), _matrix(part.column("vector").combine_chunks(), width)
        scores = products(vectors, sample)
        scores[ids[:, None] == sample_ids[None, :]] = _NONE
        floor = np.full(len(ids), _NONE)
        if scores.shape[1] >= k and len(ids):
            floor = np.partition(scores, -k, axis=1)[:, -k]  # k rows of the sample reach this
        search = spark.sparkContext.broadcast(_Search(ids, vectors, floor, pivots, top, k))

        def run(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            held, rows = [], 0

            def flush():
                some = pa.Table.from_batches(held).combine_chunks()
                columns = [some.column(i).to_numpy() for i in range(3)]
                q, v, s = search.value.run(*columns, _matrix(some.column(3).combine_chunks(), width))
                return pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

            for batch in batches:
                for start in range(0, batch.num_rows, HELD_ROWS):
                    held.append(batch.slice(start, HELD_ROWS))
                    rows += held[-1].num_rows
                    if rows >= HELD_ROWS:
                        yield flush()
                        held, rows = [], 0
            if rows:
                yield flush()

        each = checkpointed(index.mapInArrow(run, FOUND)) if blocks > 1 else index.mapInArrow(run, FOUND)
        found = each if found is None else found.unionByName(each)
    return found


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` with the highest product with each query.

    Both tables have (vec_id, vector of integers).  A query is not compared with rows of
    its own id; ties go to the smaller vec_id; fewer than ``k`` candidates give fewer rows.
    Rows that repeat are candidates each; of queries that repeat an id the smallest vector
    counts.  Vectors of another length than the query's take no part for it.
    """
    vectors = checkpointed(vectors.select("vec_id", "vector"))
    queries = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    found = None
    for row in vectors.select(F.size("vector").alias("n")).distinct().orderBy("n").collect():  # one pass per vector length
        same = F.size("vector") == row["n"]
        each = _search_width(vectors.where(same), checkpointed(queries.where(same)), row["n"], k, pivots, query_block)
        found = each if found is None else found.unionByName(each)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
