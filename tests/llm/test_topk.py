"""Threshold algorithm against full sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagekit.llm import topk
from tests import oracle
from tests.llm.conftest import CHECKED


def brute(ids, vectors, query, k, own):
    scores = vectors @ query
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != own][:k]
    return ids[order].tolist(), scores[order].tolist()


@pytest.mark.parametrize("seed", range(6))
def test_top_equals_full_sort(seed):
    rng = np.random.default_rng(seed)
    n, d = int(rng.integers(1, 600)), int(rng.integers(1, 9))
    vectors = rng.integers(-4, 5, (n, d))
    ids = rng.permutation(n)
    lists = topk.SortedLists(ids, vectors)
    for i in range(0, n, 7):
        got = lists.top(vectors[i], 5, ids[i])
        assert (got[0].tolist(), got[1].tolist()) == brute(ids, vectors, vectors[i], 5, ids[i])
    got = lists.top(np.zeros(d, dtype=np.int64), 3, -1)
    assert got[0].tolist() == sorted(ids)[:3]


def test_it_stops_before_the_end_of_the_lists():
    rng = np.random.default_rng(0)
    vectors = rng.integers(0, 1000, (20_000, 2))
    lists = topk.SortedLists(np.arange(20_000), vectors)
    met = []
    lists._doubles = type("Seen", (), {"dtype": np.dtype(float), "__getitem__": lambda s, i: met.append(np.size(i[0]) if isinstance(i, tuple) else len(i)) or vectors[i].astype(float)})()
    assert lists.top(np.array([3, 2]), 5, -1)[1].tolist() == brute(np.arange(20_000), vectors, np.array([3, 2]), 5, -1)[1]
    assert sum(met) < 10_000


def test_large_numbers_stay_exact():
    vectors = np.array([[2**30 + 1, 1], [2**30, 2**29], [2**30 + 1, 0]])
    lists = topk.SortedLists(np.array([1, 2, 3]), vectors)
    assert lists.top(np.array([2**30 + 1, 1]), 3, 0) [1].tolist() == sorted((vectors @ np.array([2**30 + 1, 1])).tolist(), reverse=True)
    with pytest.raises(OverflowError):
        lists.top(np.array([2**34, 0]), 1, 0)


def test_query_equals_sql(spark):
    con = oracle.connect(CHECKED)
    assert oracle.spark_rows(topk.query(spark, CHECKED)) == oracle.sql_rows(con, topk.CHECK)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 2)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 1)
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [nan, 1.0], 1), (3, None, 1), (4, [None, 1.0], 1)]
    rows += [(5, [inf, 1.0], 1), (None, [9.0, 9.0], 1), (6, [1.0, 2.0, 3.0], 1), (50, [-1.0, 0.0], 1), (100, None, 1), (7, [], 1)]
    raw = spark.createDataFrame(rows, "vec_id long, e array<double>, block int")
    vectors = raw.select("vec_id", topk.integers(F.col("e")).alias("v"), "block")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v")
    found = sorted(tuple(r) for r in topk.top_k(vectors, asked, 5).collect())
    one = 256 * 256 + 128 * 128
    assert found == [(0, 1, 1, one), (0, 2, 1, one), (0, 3, 50, -65536), (50, 1, 0, -65536), (50, 2, 1, -65536), (50, 3, 1, -65536)]
    assert topk.top_k(vectors.limit(0), asked.limit(0)).collect() == []
