"""Whitened embeddings against a full eigendecomposition, exact sums, odd vectors."""

import math

import numpy as np
import pytest

from passagekit.llm import whitening


def brute_force(vectors):
    x = np.floor(np.array(vectors, dtype=float) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    deviations = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    centred = (x * n - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return deviations, values, centred @ vectors


def test_query_equals_a_full_decomposition(spark, sf_dir):
    rows = whitening.query(spark, sf_dir).collect()
    found = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    deviations, values, projected = brute_force([r.embedding for r in found])
    place = {r.vec_id: i for i, r in enumerate(found)}
    assert sorted((r.vec_id, r.component) for r in rows) == sorted((i, c) for i in place for c in range(1, 9))
    for c in range(1, 9):
        mine = [r for r in rows if r.component == c]
        wanted = np.array([projected[place[r.vec_id], c - 1] for r in mine]) / math.sqrt(values[c - 1])
        got = np.array([r.whitened for r in mine])
        assert np.abs(got * np.sign(got @ wanted) - wanted).max() < 1e-9
        assert all(abs(r.explained - values[c - 1] / values.sum()) < 1e-12 for r in mine)
    assert all(r.deviation == deviations[place[r.vec_id]] and r.n == len(found) for r in rows)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string")


def test_few_dimensions_and_repeated_rows(spark):
    rng = np.random.default_rng(3)
    some = (rng.random((50, 3)) * [3, 1, 0.2] + 5).tolist()
    rows = [(i, v, "x") for i, v in enumerate(some)] * 3
    result = whitening.whitened(vectors_of(spark, rows)).collect()
    deviations, values, projected = brute_force([r[1] for r in rows])
    assert len(result) == 150 and {r.n for r in result} == {150}
    assert sorted(int(r.deviation) for r in result) == sorted(deviations)
    assert all(len(r.whitened) == 3 for r in result)
    assert np.allclose(result[0].explained, values / values.sum())
    # Repeated rows get the same numbers.
    assert len({(r.vec_id, tuple(r.whitened)) for r in result}) == 50


def test_many_close_eigenvalues_are_certified(spark):
    rng = np.random.default_rng(5)
    some = rng.standard_normal((400, 40))
    result = whitening.whitened(vectors_of(spark, [(i, v.tolist(), None) for i, v in enumerate(some)])).collect()
    _, values, projected = brute_force(some)
    got = np.array([r.whitened for r in sorted(result, key=lambda r: r.vec_id)])
    wanted = projected[:, :8] / np.sqrt(values[:8])
    assert np.abs(got * np.sign((got * wanted).sum(axis=0)) - wanted).max() < 1e-8


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, "a"), (2, [1.0, None], "a"), (3, [nan, 1.0], "a"), (4, [1.0, -inf], "a")]
    assert whitening.whitened(vectors_of(spark, odd)).collect() == []
    assert whitening.whitened(vectors_of(spark, [])).collect() == []
    fine = [(5, [0.0, 1.0], None), (None, [1.0, 1.0], "b"), (5, [0.0, 1.0], None)]
    rows = whitening.whitened(vectors_of(spark, odd + fine)).collect()
    assert sorted((r.vec_id or -1, r.n, len(r.whitened)) for r in rows) == [(-1, 3, 1), (5, 3, 1), (5, 3, 1)]
    assert all(abs(r.explained[0] - 1) < 1e-12 and r.identity_error < 1e-9 for r in rows)
    # No variance, no component.
    for same in ([(1, [2.0, 3.0], "")] * 3, [(1, [2.0], "")], [(1, [], ""), (2, [], "")]):
        rows = whitening.whitened(vectors_of(spark, same)).collect()
        assert [(r.n, int(r.deviation), r.whitened, r.explained) for r in rows] == [(len(same), 0, [], [])] * len(same)
    with pytest.raises(ValueError):
        whitening.whitened(vectors_of(spark, fine), keep=("vec_id", "n"))
    with pytest.raises(Exception, match="entries"):
        whitening.whitened(vectors_of(spark, fine + [(7, [1.0], "")])).collect()


def test_sums_beyond_64_bits_are_exact(spark):
    rows = [(1, [2.0**40, 0.0], ""), (2, [-(2.0**40), 0.0], ""), (3, [1.0, 2.0**41], "")]
    result = {r.vec_id: r for r in whitening.whitened(vectors_of(spark, rows)).collect()}
    deviations, _, _ = brute_force([[0.0, 0.0]])
    x = [[math.floor(c * 1024) + 100_000 for c in r[1]] for r in rows]
    sums = [sum(c) for c in zip(*x)]
    assert {i: int(r.deviation) for i, r in result.items()} == {
        i + 1: sum((3 * v - s) ** 2 for v, s in zip(row, sums)) for i, row in enumerate(x)
    }
