"""Exact top-k search by inner product with Fagin's threshold algorithm.

Candidates are dealt into blocks of a fixed size and queries into blocks of their own. Within a
block every dimension has a list of its candidates sorted by that component. A query reads all
lists from the end that adds most, scores each candidate it meets in full, and stops as
soon as the sum of what the lists have reached, the best that a candidate not yet met can
score, is below the k-th score found. The best of all blocks are merged. In many dimensions
most of a block is met before the bound falls low enough, so a block costs about one pass at worst.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagekit.llm.common import import_on_workers, saved, table

#: Vectors of a block, queries of a block, and the rows of each list read at first.
BLOCK = 8192
QUERY_BLOCK = 2048
FIRST_READ = 32
#: Integers up to here are exact in a double, whose products are fast.
EXACT = 2**53


class SortedLists:
    """A block of integer vectors with one sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        # By id, so that of equal scores the smaller id comes first in stable sorts.
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.rising = np.argsort(self.vectors, axis=0, kind="stable")
        limit = float(np.abs(self.vectors).max(initial=0))
        self._largest = limit
        self._doubles = self.vectors.astype(np.float64)

    def top(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best vectors but those with id ``own``, best first, ties by smaller id."""
        n, d = self.vectors.shape
        bound = float(np.abs(query).sum()) * self._largest
        if bound >= 2**63:
            raise OverflowError("inner products exceed 64 bits")
        vectors = self._doubles if bound < EXACT else self.vectors
        q = query.astype(vectors.dtype)
        down = q > 0
        used = np.nonzero(q)[0]
        met = np.zeros(n, dtype=bool)
        scores = np.zeros(n, dtype=np.int64)
        depth, step = 0, FIRST_READ
        while depth < n:
            end = min(n, depth + step)
            reach = np.where(down[used], n - end, end - 1)
            rows = self.rising[reach, used]
            front = np.concatenate(
                [self.rising[n - end : n - depth, used[down[used]]].ravel(), self.rising[depth:end, used[~down[used]]].ravel()]
            )
            fresh = np.zeros(n, dtype=bool)
            fresh[front if len(used) else slice(depth, end)] = True
            fresh = np.nonzero(fresh & ~met)[0]
            met[fresh] = True
            scores[fresh] = vectors[fresh] @ q
            threshold = (q[used] * vectors[rows, used]).sum()
            depth, step = end, step * 2
            found = np.nonzero(met & (self.ids != own))[0]
            if len(found) >= k and np.partition(scores[found], len(found) - k)[len(found) - k] > threshold:
                break
        found = np.nonzero(met & (self.ids != own))[0]
        best = found[np.argsort(-scores[found], kind="stable")[:k]]
        return self.ids[best], scores[best]


def integers(vector: Column) -> Column:
    """floor(256 x) of each component as long; null for a vector that is or holds null or is not finite."""
    wide = vector.cast("array<double>")
    wrong = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(wrong, F.lit(True)), F.transform(wide, lambda x: F.floor(256 * x)))


_FOUND = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best ``vec_id`` for each ``query_id``, with ``rank`` from 1 and ``score``.

    ``vectors`` has ``vec_id`` and ``v``, ``queries`` has ``query_id`` and ``v`` (arrays of long).
    A query meets vectors of its length only, and none of its own id. Rows with a null id
    or vector take no part. Of repeated query ids the smallest vector is the query; repeated
    vectors are separate candidates. Equal scores rank by smaller ``vec_id``. A query
    without candidates, as in an empty table, has no rows.
    """
    spark = vectors.sparkSession
    import_on_workers(spark)
    # Rows are dealt by a number of their own, fixed in the written tables, so that no common id or vector fills a block.
    number = F.xxhash64(F.monotonically_increasing_id()).alias("number")
    vectors = saved(vectors.where("vec_id IS NOT NULL AND v IS NOT NULL").select("vec_id", "v", number))
    queries = queries.where("query_id IS NOT NULL AND v IS NOT NULL").groupBy("query_id").agg(F.min("v").alias("v"))
    queries = saved(queries.select("query_id", "v", number))
    blocks = max(1, math.ceil(vectors.count() / BLOCK))
    query_blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))

    def dealt(df: DataFrame, of: str, own: str, n: int, other: str, m: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)
        return df.select(of, "v", F.size("v").alias("d"), F.pmod("number", F.lit(n)).cast("int").alias(own), every)

    left = dealt(vectors, "vec_id", "block", blocks, "query_block", query_blocks)
    right = dealt(queries, "query_id", "query_block", query_blocks, "block", blocks)

    def search(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        found = {"query_id": [], "vec_id": [], "score": []}
        if candidates.num_rows and asked.num_rows:
            lists = SortedLists(candidates["vec_id"].to_numpy(), _matrix(candidates))
            for own, query in zip(asked["query_id"].to_pylist(), _matrix(asked), strict=True):
                ids, scores = lists.top(query, k, own)
                found["query_id"] += [own] * len(ids)
                found["vec_id"] += ids.tolist()
                found["score"] += scores.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in found.items()})

    key = ["block", "query_block", "d"]
    best = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _matrix(rows: pa.Table) -> np.ndarray:
    flat = pa.concat_arrays(c.flatten() for c in rows["v"].chunks).to_numpy()
    return flat.reshape(rows.num_rows, -1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best neighbours of every fiftieth embedding among all embeddings."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", integers(F.col("embedding")).alias("v"))
    asked = rows.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "v")
    return top_k(rows, asked)


CHECK = """
WITH rows AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, vec_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
