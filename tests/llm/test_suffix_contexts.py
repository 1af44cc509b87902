"""Scores of the whole tree against brute force, with contexts of any rarity and with frequent ones counted beforehand."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from passagekit.llm import suffix_contexts, suffix_tree
from passagekit.llm.common import saved, utf8_of


def rows():
    """Texts of words of all frequencies; some twice, null, empty or of one word, keys null or repeated."""
    draw = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    texts = []
    for _ in range(60):
        text = draw.choices(words, weights, k=draw.randint(1, 90))
        texts.append(" ".join(w.upper() if draw.random() < 0.1 else w for w in text))
    # A rare word that is always followed by the same one, and a phrase that occurs in many texts.
    texts += ["seldom\tseen then", "seldom seen  then w0", "w0 w1 w0 w1 " * 20] + [f"out of the n{i}" for i in range(30)]
    found = [*enumerate(texts), *enumerate(texts[:9], 5), (None, texts[3]), (None, None), (2, None), (3, ""), (4, "w0")]
    return [*found, (500, "alone " * 300)]


def brute_force(rows):
    """Sorted (n_tokens, base, score) of all rows, by dictionaries."""
    words = [[*(text or "").lower().split(), "\n"] for _, text in rows]
    learned = [zlib.crc32(str("" if i is None else i).encode()) % 10 != 0 for i, _ in rows]
    counts, contexts = Counter(), defaultdict(Counter)
    for ws, learn in zip(words, learned, strict=True):
        if learn:
            counts.update(ws)
            padded = ["\n", "\n", *ws]
            for o, w, x in zip(padded, padded[1:], padded[2:], strict=False):
                contexts[(w,)][x] += 1
                contexts[o, w][x] += 1
    n, v = sum(counts.values()), len(counts)
    root = lambda x: (counts[x] + 0.1) / (n + 0.1 * (v + 1))

    def is_node(context):
        following = contexts.get(context)
        if not following:
            return False
        total = sum(following.values())
        shorter = contexts.get(context[1:], {}) if len(context) > 1 else None
        parent = lambda x: root(x) if shorter is None else shorter[x] / sum(shorter.values())
        gain = sum(c * math.log(c / total / parent(x)) for x, c in following.items())
        return gain >= 0.02 * total and gain >= 2.0 * len(following)

    nodes = {context for context in contexts if is_node(context)}

    def probability(o, w, x):
        p = root(x)
        for context in ((w,), (o, w)):
            if context in nodes:
                p = (contexts[context][x] + 20 * p) / (sum(contexts[context].values()) + 20)
        return p

    found = []
    for ws in words:
        padded = ["\n", "\n", *ws]
        score = sum(math.log10(probability(*t)) for t in zip(padded, padded[1:], padded[2:], strict=False))
        found.append((len(ws), sum(math.log10(root(x)) for x in ws), score))
    assert any(len(context) == 2 for context in nodes) and any(len(context) == 1 for context in nodes)
    return sorted(found)


def same(found, expected):
    found = sorted((r.n_tokens, r.base_score, r.score) for r in found)
    assert [x[0] for x in found] == [x[0] for x in expected]
    assert np.allclose(found, expected, rtol=1e-9, atol=1e-8)


def test_rare_contexts_score_as_by_brute_force(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    same(suffix_tree.score_documents(docs).collect(), brute_force(rows()))


@pytest.mark.parametrize("frequent", [300, 40, 3])
def test_frequent_contexts_counted_beforehand_and_small_parts_change_nothing(spark, monkeypatch, frequent):
    monkeypatch.setattr(suffix_contexts, "FREQUENT", frequent)
    monkeypatch.setattr(suffix_contexts, "PART", 150)
    monkeypatch.setattr(suffix_contexts, "NUMBERED", 50)
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 3000)
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    training = docs.where(~suffix_tree.held_out()).select(utf8_of("text").alias("text"))
    counts = saved(suffix_tree.token_counts(training))
    tree = suffix_tree.grow(training, counts)
    assert tree.ones and (frequent == 300 or tree.twos) and tree.parts > 1
    same(suffix_tree.score_documents(docs).collect(), brute_force(rows()))


def test_columns_are_packed_whole():
    columns = [np.array(x) for x in ([0, 255, 256, 2**40], [], [7], [0, 0])]
    for found, column in zip(suffix_contexts.unpacked(suffix_contexts.packed(*columns)), columns, strict=True):
        assert found.tolist() == column.tolist()
    sums = np.array([-1.5, 0.25])
    assert suffix_contexts.unpacked(suffix_contexts.packed(sums.view(np.uint64)))[0].view(float).tolist() == [-1.5, 0.25]


def test_order_is_the_same_whether_the_columns_fit_one_number():
    draw = np.random.default_rng(3)
    columns = [draw.integers(0, 9, 500) for _ in range(3)]
    narrow, wide = suffix_contexts._order(columns, 9), suffix_contexts._order(columns, 1 << 40)
    assert all((c[narrow] == c[wide]).all() for c in columns)
