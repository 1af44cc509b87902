"""Packing against a brute-force tokenisation, and its plan against an exhaustive search."""

import itertools
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from passagekit.llm import bpe, packing

PATH = bpe.vocabulary_path()
TEXTS = [(1, "The quick brown fox"), (2, None), (3, ""), (3, "twice"), (3, "twice"), (None, "no id"), (4, "word " * 90), (5, "x y " * 40)]


@pytest.fixture(scope="module")
def packed(spark):
    docs = spark.createDataFrame([(i, t, 7, 8) for i, t in TEXTS], "doc_id long, text string, length int, _salt int")
    return packing.packed(docs, PATH, capacity=32).collect()


def test_pieces_are_those_of_the_library(packed):
    library = Tokenizer.from_file(PATH)
    wanted = []
    for doc_id, text in TEXTS:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        bounds = [0, *range((len(ids) - 1) % 32 + 1, len(ids) + 1, 32)]
        for i, (a, b) in enumerate(itertools.pairwise(bounds)):
            wanted.append((doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    key = lambda row: tuple((x is not None, x or 0) for x in row)
    assert sorted((tuple(r)[:5] for r in packed), key=key) == sorted(wanted, key=key)


def test_sequences_have_no_gaps_and_fit(packed):
    by_sequence = {}
    for row in packed:
        by_sequence.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for rows in by_sequence.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 32
    assert len(by_sequence) == -(-sum(r.length for r in packed) // 32)


@pytest.mark.parametrize("seed", range(20))
def test_fullest_combination_equals_exhaustive_search(seed):
    rng = np.random.default_rng(seed)
    available = {int(x): int(rng.integers(1, 4)) for x in rng.choice(np.arange(2, 30), 5, replace=False)}
    room = int(rng.integers(5, 70))
    sums = [
        sum(n * x for n, x in zip(counts, available, strict=True))
        for counts in itertools.product(*(range(n + 1) for n in available.values()))
    ]
    chosen = packing.fullest(room, available)
    assert sum(x * n for x, n in chosen.items()) == max(s for s in sums if s <= room)
    assert all(n <= available[x] for x, n in chosen.items())


def test_combinations_use_up_all_pieces():
    counts = {5: 1000, 7: 3, 12: 999, 31: 17, 32: 4}
    used = {}
    for times, chosen in packing.combinations(counts, 32):
        assert sum(x * n for x, n in chosen) <= 32
        for x, n in chosen:
            used[x] = used.get(x, 0) + times * n
    assert used == counts


def test_checksums_are_those_of_the_ids(spark):
    docs = spark.createDataFrame([(1, "some words " * 40), (2, None)], "doc_id long, text string")
    whole = packing.pieces(docs, PATH, 16).collect()
    sums = packing.pieces(docs, PATH, 16, checksums=True).collect()
    assert [(*r[:4], zlib.crc32(r.ids)) for r in whole] == [tuple(r) for r in sums]


def test_empty_table_and_wrong_lengths(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed(nothing, PATH).collect() == []
    for wrong in (0, 33, None):
        with pytest.raises(ValueError, match="lengths"):
            packing.pack(spark.createDataFrame([(wrong,)], "length long"), 32)


def test_very_long_runs_of_white_space_and_symbols(spark):
    """The tokeniser's pattern gives up on some of these; the ids are those of the rank arrays."""
    texts = [" " * 1_000_000, "a" + "\n" * 1_000_000 + "b", " \n\t" * 400_000 + "x", "!?" * 300_000, "a" * 300_000, "\u3000" * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = {r.doc_id: np.array(r.ids, dtype="<u4") for r in bpe.encoded(docs, PATH).collect()}
    found = {}
    for r in sorted(packing.packed(docs, PATH).collect(), key=lambda r: (r.doc_id, r.piece)):
        found.setdefault(r.doc_id, []).append(r)
    for doc_id, rows in found.items():
        whole = np.append(ids[doc_id], np.uint32(0)).astype("<u4")
        assert sum(r.length for r in rows) == len(whole)
        assert all(zlib.crc32(whole[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in rows)
    assert set(found) == set(range(len(texts)))


def test_pieces_that_fill_a_sequence_are_not_ranked(spark, monkeypatch):
    """Equal rows of any number are spread over parts of bounded size; full ones are given their own sequence."""
    monkeypatch.setattr(packing, "PER_PART", 10)
    parts = spark.range(500).selectExpr("7L AS doc_id", "IF(id < 300, 32L, IF(id < 450, 20L, 12L)) AS length")
    packed = packing.pack(parts, 32)
    rows = packed.collect()
    full = [r.sequence_id for r in rows if r.length == 32]
    assert len(full) == len(set(full)) == 300 and all(r.offset == 0 for r in rows if r.length == 32)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(by_sequence) == 300 + 150
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 32
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    ranked = [line for line in plan.splitlines() if "row_number()" in line]
    assert len(ranked) == 1 and "_part#" in ranked[0] and "_row#" in ranked[0]
    with pytest.raises(ValueError):
        packing.pack(parts.withColumnRenamed("doc_id", "_row"), 32)


def test_texts_are_encoded_once(spark):
    """A filter on the pieces would encode every text a second time, in a Python worker of its own."""
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    plan = packing.pieces(docs, PATH, 32, checksums=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
