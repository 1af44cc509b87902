"""The additive model: held-out accuracy, interactions, odd rows."""

import zlib

import numpy as np

from passagekit.llm import quality_model as model


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    scored = {r.doc_id: r for r in model.query(spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in scored.items())
    held = [(scored[r.doc_id], r.quality) for r in labels if scored[r.doc_id].held_out]
    assert len(held) > 50
    assert sum(s.predicted == q for s, q in held) / len(held) > 0.97


def test_tables_learn_a_step_and_an_interaction():
    rng = np.random.default_rng(1)
    rows = rng.random((4000, len(model.FEATURES)))
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 1] > 0.5)).astype(float)
    fitted = model.fit(rows, labels)
    assert (0, 1) in fitted.pairs
    fresh = rng.random((2000, len(model.FEATURES)))
    wanted = (fresh[:, 0] > 0.5) ^ (fresh[:, 1] > 0.5)
    assert ((fitted.score(fresh) > 0.5) == wanted).mean() > 0.9
    again = model.fit(rows, labels)
    assert np.array_equal(again.score(fresh), fitted.score(fresh))


def test_without_examples_nothing_is_rejected():
    rows = np.zeros((3, len(model.FEATURES)))
    assert (model.fit(rows[:0], np.zeros(0)).score(rows) > 0.999).all()
    assert (model.fit(rows, np.ones(3)).score(rows) > 0.999).all()
    assert np.allclose(model.fit(rows, np.zeros(3)).score(rows), 0.25)


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "good words here.", "a"), (2, None, "b"), (2, "", "b"), (None, "$$$ ### !!!", None), (3, "w" * 200_000, "c")],
        "doc_id long, text string, quality string",
    )
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (None, 1), (9, 5)], "doc_id long, quality int")
    rows = model.with_score(docs, labels, out_col="quality_score").collect()
    assert len(rows) == 5 and all(0 <= r.quality_score <= 1 for r in rows)
    assert len({r.quality_score for r in rows if r.doc_id == 2}) == 1
    assert {r.quality for r in rows} == {"a", "b", "c", None}
    assert model.with_score(docs.limit(0), labels).collect() == []


def test_copies_and_unknown_ids_stay_within_the_bound(spark, monkeypatch):
    """Repeated rows are folded before anything is collected, and ids without a document use up no place."""
    seen = []
    fit = model.fit
    monkeypatch.setattr(model, "fit", lambda x, y: seen.append(len(x)) or fit(x, y))
    docs = spark.range(2000).selectExpr("id % 10 AS doc_id", "CONCAT('some words ', id % 10) AS text")
    labels = spark.range(5000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    model.train(docs, labels, max_examples=8)
    model.train(docs, labels, max_examples=100)
    many = spark.range(2000).selectExpr("1L AS doc_id", "CONCAT('text ', id) AS text")
    model.train(many, labels, max_examples=50)
    assert seen == [8, 10, 50]
