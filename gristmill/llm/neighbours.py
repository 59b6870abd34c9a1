"""Operator 7: approximate nearest neighbours (largest inner products) with a permutation index.

Vectors are indexed with one more component, sqrt(M**2 - |v|**2), and queries with 0 there, so that the nearest direction is
the largest inner product, whatever the lengths. M is the length that LONG of a shard's vectors do not exceed; the few
longer ones are ranked again for every query, beside the share below.

Each vector is represented by the order of its nearest pivots and posted, with the place in that order, in the inverted
file of each of its POSTED nearest pivots. A query reads the files of its ASKED nearest pivots and sums, for each vector
there, how far apart the pivot's two places are; a vector that a file lacks counts as one place behind the last (the
footrule distance of the two orders, cut to those places). The SHARE of vectors with the smallest distances (LEAST at
least) is ranked again by exact inner products in double precision.

Vectors are dealt to shards of about SHARD vectors and queries to blocks of about QUERIES, so each task searches one
shard for one block, and the share that is ranked again, hence recall, does not fall as the table grows. Pivots are
PIVOTS distinct vectors with the smallest hashes of vec_id.

Rows with a null vec_id, a null or zero vector, null or non-finite components, or another length than most vectors take
no part. Ties in the score go to the smaller vec_id; equal vectors are told apart by vec_id at every step. Rows with the
query's vec_id are not its candidates; a repeated query is asked once. Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table

PIVOTS, POSTED, ASKED = 256, 128, 64
SHARE, LEAST = 0.12, 800
LONG = 0.99
SHARD, QUERIES = 16384, 1024
NEAREST = 20


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (double) of rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    v = v.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    length = v.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    return v if length is None else v.where(F.size("vector") == length["length"])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks])
    return flat.reshape(len(column), -1)


def pivot_order(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Numbers of the pivots, from the nearest on; vectors are compared by direction."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.argsort(-np.round(unit @ pivots.T, 12), axis=1, kind="stable")


def lifted(vectors: np.ndarray, length: float) -> np.ndarray:
    """Vectors with a component that makes shorter ones as long as length."""
    return np.column_stack([vectors, np.sqrt(np.maximum(length * length - (vectors * vectors).sum(axis=1), 0))])


class InvertedFiles:
    """For each pivot, the vectors that have it among their nearest, and its place in their order."""

    def __init__(self, order: np.ndarray, posted: int, pivots: int):
        self.n, self.posted = order.shape[0], min(posted, pivots)
        order = order[:, : self.posted]
        pivot, row = order.T.ravel(), np.tile(np.arange(self.n, dtype=np.int32), self.posted)
        place = np.repeat(np.arange(self.posted, dtype=np.int16), self.n)
        by = np.argsort(pivot, kind="stable")
        self.row, self.place = row[by], place[by]
        self.first = np.searchsorted(pivot[by], np.arange(pivots + 1))

    def footrule(self, asked: np.ndarray) -> np.ndarray:
        """Distance of every vector from a query's order of pivots."""
        out = np.full(self.n, sum(abs(self.posted - k) for k in range(len(asked))), np.int32)
        for k, pivot in enumerate(asked.tolist()):
            a, b = self.first[pivot], self.first[pivot + 1]
            out[self.row[a:b]] += np.abs(self.place[a:b] - k) - abs(self.posted - k)
        return out


_OUT = "query_id long, vec_id long, score double"


def search(vectors: pa.Table, queries: pa.Table, pivots: np.ndarray, nearest: int) -> pa.Table:
    """The nearest vectors of a shard to each query of a block."""
    out: list[list] = [[], [], []]
    if vectors.num_rows and queries.num_rows:
        vectors = vectors.sort_by("vec_id")
        ids, matrix = vectors.column("vec_id").to_numpy(), _matrix(vectors.column("vector"))
        size = np.linalg.norm(matrix, axis=1)
        length = np.quantile(size, LONG, method="higher")
        long = size > length
        pivots = lifted(pivots, length)
        pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
        files = InvertedFiles(pivot_order(lifted(matrix, length), pivots), POSTED, len(pivots))
        some = min(len(ids), max(LEAST, int(SHARE * len(ids))) + int(long.sum()))
        asked = _matrix(queries.column("vector"))
        orders = pivot_order(lifted(asked, 0), pivots)[:, :ASKED]
        for query_id, q, order in zip(queries.column("vec_id").to_pylist(), asked, orders, strict=True):
            rank = files.footrule(order).astype(np.int64) * len(ids) + np.arange(len(ids))
            rank[long] = -1
            rank[ids == query_id] = np.iinfo(np.int64).max
            rows = np.argpartition(rank, some - 1)[:some]
            rows = np.sort(rows[ids[rows] != query_id])
            score = (matrix[rows] * q).sum(axis=1)
            top = np.lexsort((ids[rows], -score))[:nearest]
            out[0] += [query_id] * len(top)
            out[1] += ids[rows[top]].tolist()
            out[2] += score[top].tolist()
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score of each query's nearest vectors (both tables: vec_id, embedding)."""
    spark = vectors.sparkSession
    v = cut(usable(vectors))
    n = v.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    first = v.select("vec_id", "vector", F.xxhash64("vec_id").alias("h")).orderBy("h", "vec_id").limit(8 * PIVOTS).collect()  # a bounded sample
    pivots = np.array(list(dict.fromkeys(tuple(r["vector"]) for r in first))[:PIVOTS])
    q = usable(queries).dropDuplicates(["vec_id"]).where(F.size("vector") == pivots.shape[1])
    shards, blocks = max(1, round(n / SHARD)), max(1, round(q.count() / QUERIES))
    shard, block = F.pmod(F.xxhash64("vec_id"), F.lit(shards)), F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    left = v.select("vec_id", "vector", shard.alias("shard"), every(blocks).alias("block")).groupBy("shard", "block")
    right = q.select("vec_id", "vector", every(shards).alias("shard"), block.alias("block")).groupBy("shard", "block")
    found = left.cogroup(right).applyInArrow(lambda a, b: search(a, b, pivots, nearest), _OUT)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # of nearest rows from each shard
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"))
