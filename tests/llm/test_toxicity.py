"""FTRL-proximal regression: one step by hand, held-out accuracy, sparsity, odd rows."""

import math
import zlib

import numpy as np
import pytest

from passagekit.llm import toxicity


def test_features_are_words_beginnings_pairs_and_skip_grams():
    one = set(toxicity.features(b"Alpha"))
    assert len(one) == 2  # the word and its first four letters
    four = toxicity.features("a b ç d".encode())
    # 4 words, 3 pairs, 2 with one word between, 1 with two.
    assert len(four) == 10 and (np.diff(four) > 0).all()
    assert set(toxicity.features(b"a x b")) & set(toxicity.features(b"a y b")) > set(toxicity.features(b"a")) | set(
        toxicity.features(b"b")
    )
    assert len(toxicity.features(b"")) == len(toxicity.features(b" \n $$$")) == 0
    assert set(toxicity.features(b"a " * 100_000)) == set(toxicity.features(b"a a a a"))


def test_steps_equal_the_formula_by_hand():
    """z, n and the weights of the published update, one coordinate at a time."""
    z, n = [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]

    def weight(i):
        shrunk = 0 if i < 2 and abs(z[i]) <= toxicity.L1 else z[i] - (math.copysign(toxicity.L1, z[i]) if i < 2 else 0)
        return -shrunk / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    state = toxicity.Ftrl()
    for step in range(60):
        at, label = ([0], 1) if step % 3 == 0 else ([0, 1], step % 2) if step % 3 == 1 else ([1], 0)
        state.learn(np.array(at), label)
        used = [*at, 2]
        w = [weight(i) for i in used]
        g = 1 / (1 + math.exp(-sum(w))) - label
        for i, x in zip(used, w):
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
            z[i] += g - sigma * x
            n[i] += g * g
    where = [0, 1, toxicity.COORDINATES]
    assert np.allclose(state.z[where], z) and np.allclose(state.n[where], n)
    assert np.count_nonzero(state.n) == 3


@pytest.fixture(scope="module")
def scored(spark):
    return {r.doc_id: r for r in toxicity.query(spark, "/root/testdata/sf0.1").collect()}


def test_held_out_accuracy(spark, scored):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in scored.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored.values())
    held = [(scored[r.doc_id].predicted, r.toxic) for r in labels if scored[r.doc_id].held_out]
    toxic = [p for p, y in held if y == 1]
    clean = [p for p, y in held if y == 0]
    assert len(toxic) > 50
    assert sum(toxic) / len(toxic) > 0.85
    assert sum(clean) / len(clean) < 0.01


def test_held_out_labels_are_not_learned(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    turned = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    first = {r.doc_id: r.toxicity for r in toxicity.with_score(docs, labels).collect()}
    assert first == {r.doc_id: r.toxicity for r in toxicity.with_score(docs, turned).collect()}
    assert len(set(first.values())) > 1


def test_weights_are_sparse_and_the_bound_holds(spark, sf_dir):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.train(docs, labels)
    assert 0 < len(model.coordinates) < toxicity.COORDINATES / 100
    docs = docs.dropDuplicates(["text"])
    labels = labels.join(docs, "doc_id", "left_semi")
    assert toxicity.examples_of(docs, labels, "doc_id", "text", "toxic", 50).count() == 50
    # Ids without a document do not use up the bound.
    more = labels.unionByName(labels.selectExpr("doc_id + 10000000 AS doc_id", "quality", "toxic"))
    assert toxicity.examples_of(docs, more, "doc_id", "text", "toxic", 50).count() == 50
    # One id with many texts stays within it.
    copies = docs.selectExpr("7L AS doc_id", "text")
    one = labels.limit(1).selectExpr("7L AS doc_id", "1 AS toxic")
    assert toxicity.examples_of(copies, one, "doc_id", "text", "toxic", 50).count() == 50


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "you idiot clown", "a"), (2, None, "b"), (2, "", "b"), (None, "fine words", None), (3, "w " * 200_000, "c"),
         (1, "you idiot clown", "a"), (4, "good words here", "d")],
        "doc_id long, text string, label string",
    )
    labels = spark.createDataFrame(
        [(1, 1), (1, 1), (1, 0), (2, 0), (3, None), (None, 1), (9, 5), (4, 0)], "doc_id long, toxic int"
    )
    rows = toxicity.with_score(docs, labels).collect()
    assert len(rows) == 7 and all(0 <= r.toxicity <= 1 for r in rows)
    assert len({r.toxicity for r in rows if r.doc_id == 2}) == 1
    assert len({r.toxicity for r in rows if r.doc_id == 1}) == 1
    assert {r.label for r in rows} == {"a", "b", "c", "d", None}
    assert toxicity.with_score(docs.limit(0), labels).collect() == []
    assert {r.toxicity for r in toxicity.with_score(docs, labels.limit(0)).collect()} == {0.5}
    with pytest.raises(ValueError):
        toxicity.with_score(docs, labels, out_col="label")
