"""Base rules against brute force, and the likelihood ratio on a small corpus."""

import math
import re
from collections import Counter

import pytest

from passagekit.llm import quality_rules as rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside)


TEXTS = [
    "",
    " \n\t ",
    "one two",
    "a b c a b c a b",
    "a a a a a",
    "été #1 <b>|x| \x1c \xa0 word\n\nété #1 <b>|x| \x1c \xa0 word\n  \nlast",
    "same line\nsame line\n same line\n",
    "w" * 100_000 + " end",
]


def test_base_counts_equal_brute_force(sf_dir, spark):
    docs = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts = TEXTS + docs
    raw = [t.encode() for t in texts]
    counts = rules.base_counts(raw, rules.Batch(raw))
    assert list(zip(*(c.tolist() for c in counts), strict=True)) == [brute(t) for t in texts]


@pytest.fixture(scope="module")
def judged(spark):
    good, bad = "the cat sat on a mat and saw birds ", "buy $$$ now %%% click ### here &&& "
    rows = [(i, f"{good * 9} {i} {' '.join(f'g{i}x{k}' for k in range(30))}", "x") for i in range(30)]
    rows += [(100 + i, f"{bad * 9} {' '.join(f'b{i}x{k}' for k in range(90))}", None) for i in range(30)]
    rows += [(None, None, "n"), (200, "", "e"), (201, "few words", "f"), (201, "few words", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    trusted = spark.createDataFrame([(i,) for i in range(20)] + [(3,), (None,), (999,)], "doc_id long")
    return rules.with_verdict(docs, trusted).collect(), docs, trusted


def test_likelihood_ratio_divides_good_from_bad(judged):
    rows = judged[0]
    assert len(rows) == 64
    ratio = {r.doc_id: r.quality_rules.llr for r in rows if r.doc_id is not None}
    bad = max(ratio[100 + i] for i in range(30))
    # Documents 20 to 29 are good too but outside the target, which has not seen their own 30 words.
    assert min(ratio[i] for i in range(20)) > 0 > rules.THRESHOLD > bad
    assert 0 > min(ratio[i] for i in range(20, 30)) > bad
    assert all(r.quality_rules.base_failed and not r.quality_rules.kept for r in rows if r.doc_id in (None, 200, 201))
    assert {r.kept for r in rows} == {"x", None, "n", "e", "f"}


def test_multinomials_equal_brute_force(judged):
    _, docs, trusted = judged
    known = {r.doc_id for r in trusted.collect()} - {None}
    marked = docs.withColumn("flag", docs["doc_id"].isin(list(known)))
    found = rules.multinomials(marked, marked["flag"], buckets=64).collect()
    raw, target = Counter(), Counter()
    for row in docs.collect():
        buckets, _ = rules.Batch([(row.text or "").encode()]).n_grams(64)
        raw.update(buckets.tolist())
        if row.doc_id in known:
            target.update(buckets.tolist())
    assert {(r.bucket, r.raw, r.target) for r in found} == {(b, n, target[b]) for b, n in raw.items()}


def test_ratios_equal_brute_force(judged):
    rows, docs, trusted = judged
    known = {r.doc_id for r in trusted.collect()} - {None}
    raw, target = Counter(), Counter()
    grams = {}
    for row in docs.collect():
        text = (row.text or "").encode()
        grams[text] = rules.Batch([text]).n_grams(rules.BUCKETS)[0].tolist()
        raw.update(grams[text])
        if row.doc_id in known:
            target.update(grams[text])
    total = {id(c): sum(c.values()) + rules.PRIOR * rules.BUCKETS for c in (raw, target)}

    def share(counts, bucket):
        return (counts[bucket] + rules.PRIOR) / total[id(counts)]

    for row in rows:
        own = grams[(row.text or "").encode()]
        ratio = sum(math.log(share(target, b) / share(raw, b)) for b in own) / max(len(own), 1)
        assert math.isclose(row.quality_rules.llr, ratio, abs_tol=1e-9)
        assert row.quality_rules.kept == (not row.quality_rules.base_failed and row.quality_rules.llr >= rules.THRESHOLD)


def test_without_target_the_base_rules_decide(spark, judged):
    docs = judged[1]
    rows = rules.with_verdict(docs, docs.select("doc_id").limit(0)).collect()
    assert all(r.quality_rules.kept != r.quality_rules.base_failed and math.isclose(r.quality_rules.llr, 0) for r in rows)
    assert rules.with_verdict(docs.limit(0), docs.select("doc_id")).collect() == []
