"""Counts and base scores against brute force; probabilities add up; contexts help on held-out text."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from passagekit.llm import suffix_tree
from passagekit.llm.common import saved, utf8_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*WORD.findall((text or "").translate(LOW)), "\n"]


def test_scores_equal_brute_force_at_the_root(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    counts = Counter(t for i, text in docs.items() if not held[i] for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    rows = suffix_tree.query(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = tokens(docs[r.doc_id])
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(own), n)
        assert r.n_known == sum(counts[t] > 0 for t in own)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    assert sum(r.score - r.base_score for r in rows if r.held_out) > 0


@pytest.fixture(scope="module")
def tree(spark):
    text = "a b c . " * 200 + "b d . c a . " * 100 + " ".join(f"rare{i} a" for i in range(50))
    docs = spark.createDataFrame([(text,), ("a b c .",)] * 3, "text string").select(utf8_of("text").alias("text"))
    counts = saved(suffix_tree.token_counts(docs))
    return suffix_tree.grow(docs, counts, suffix_tree.Shares(0.01, 0.01, 1e-6)), counts


def test_distributions_add_up_in_every_context(tree):
    model, counts = tree
    assert len(model.ones[0]) and len(model.twos[0])
    every = np.arange(model.other + 1)
    for older in every:
        for last in every:
            p = model.probability(np.full(len(every), older), np.full(len(every), last), every)
            assert math.isclose(p.sum(), 1, rel_tol=1e-9) and (p > 0).all()
    known = np.array([r.c for r in counts.collect()])
    unseen = model.root_probability(np.array([0]))
    assert math.isclose(model.root_probability(known).sum() + unseen.sum(), 1, rel_tol=1e-9)


def test_longest_context_wins(tree):
    model, _ = tree
    a, b, c, stop = (model.symbols[t] for t in (b"a", b"b", b"c", b"."))
    p = lambda older, last, nxt: model.probability(*(np.array([x]) for x in (older, last, nxt)))[0]
    assert p(a, b, c) > p(stop, b, c)
    assert p(a, b, c) > 0.9


def test_odd_rows(spark):
    rows = [(1, "One two", 1), (1, "One two", 1), (None, "one", 2), (2, None, 3), (3, "", 4), (4, "w " * 100_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, c int")
    found = suffix_tree.score_documents(docs).collect()
    assert sorted(r.n_tokens for r in found) == [1, 1, 2, 3, 3, 100_001]
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in found)
    assert suffix_tree.score_documents(docs.limit(0)).collect() == []


def test_ends_are_counted_however_rare_they_are(spark):
    """With texts of 25,000 words an end is no frequent token, and still a known one."""
    texts = [" ".join(f"w{(i * 7 + k) % 400}" for i in range(25_000)) for k in range(4)]
    rows = [(i, texts[i % 4]) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    training = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for t in training for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for r in suffix_tree.score_documents(docs).collect():
        own = tokens(dict(rows)[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (25_001, 25_001, n)
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)


def test_texts_are_shuffled_once(spark, capsys):
    """Finding the tokens of a block and scoring its texts read the same shuffle."""
    docs = spark.createDataFrame([(i, f"w{i % 7} x y") for i in range(200)], "doc_id long, text string")
    plain = docs.select("doc_id", utf8_of("text").alias("text")).withColumnRenamed("doc_id", "id")
    counts = saved(suffix_tree.token_counts(plain))
    tree = suffix_tree.grow(plain, counts)
    found = suffix_tree.scores(plain, counts, tree, 4, 200)
    assert found.count() == 200
    found.collect()
    found.explain()
    plan = capsys.readouterr().out.split("Initial Plan")[0]
    assert plan.count("REPARTITION_BY_NUM") == 2 and plan.count("ReusedExchange") == 1
