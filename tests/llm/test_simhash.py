"""Fingerprints by definition, links and components against brute force, crowded cells."""

import random

import numpy as np
import pytest
import xxhash

from passagekit.llm import simhash
from passagekit.llm.components import components


def brute_fingerprint(text, n=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_fingerprint_is_that_of_the_definition():
    rng = random.Random(2)
    for n_words in (0, 1, 2, 3, 4, 50, 400):
        text = " ".join(rng.choice(["The", "été", "x", "ÀB", "of"]) for _ in range(n_words))
        assert simhash.simhash(text.encode(), 3) % 2**64 == brute_fingerprint(text)


def _nodes(spark, fingerprints):
    signed = sorted({f - 2**64 if f >= 2**63 else f for f in fingerprints})
    return spark.createDataFrame(list(zip(signed, range(len(signed)), strict=True)), "fp long, node long"), signed


@pytest.mark.parametrize("crowded", [64, 3])
@pytest.mark.parametrize("max_bits", [0, 1, 2])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, crowded, max_bits):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, 2**64 - 1, 1 << 63]
    found = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(12)}
    nodes, signed = _nodes(spark, found)
    values = np.array(signed, dtype=np.int64).view(np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= max_bits
    wanted = [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j]
    links = [(r.a, r.b) for r in simhash.links(nodes, max_bits).collect()]
    assert all(near[a, b] for a, b in links) and len(set(links)) == len(links)
    if crowded == 64:
        assert sorted(links) == wanted
    assert roots(links, range(len(signed))) == roots(wanted, range(len(signed)))


def test_components_of_long_paths(spark):
    rng = random.Random(3)
    order = rng.sample(range(300), 300)
    links = list(zip(order[:150], order[1:150])) + list(zip(order[150:], order[151:])) + [(5, 5)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    wanted = roots(links, range(300))
    assert {r.node: r.root for r in found} == {n: wanted[n] for n in range(300)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_odd_rows(spark):
    long = "many words in a very long text " * 20_000
    rows = [(5, "Same Text here ok", 1), (3, "same text HERE ok", 2), (3, "same text here ok", 2), (None, "same text here ok", 3)]
    rows += [(9, None, 0), (8, "", 0), (7, " \n", 0), (None, "alone without an id", 0), (1, long, 0), (2, long + "end", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    found = simhash.near_duplicates(docs).collect()
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert len(found) == 10
    assert {by_id[i].component_id for i in (3, 5)} == {3}
    assert {by_id[i].component_id for i in (7, 8, 9)} == {7} and by_id[7].fingerprint == "0" * 16
    assert {by_id[i].component_id for i in (1, 2)} == {1}
    assert sorted((r.component_id for r in found if r.doc_id is None), key=str) == [3, None]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
