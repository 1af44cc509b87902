"""Encoding and decoding against the library of the vocabulary file."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from passagekit.llm import bpe

PATH = bpe.vocabulary_path()
PARTS = [" ", "\n", "\t", "\xa0", "　", "\x1c", "\x85", "a", "the", "é", "ñ", "1", "²", "½", "!", "<|endoftext|>", "'s", "一", "👍", "\x00", "  ", "x" * 90, "ing"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(PATH), remembered=500)


def test_random_texts_equal_the_library(library, encoder):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for start in range(0, len(texts), 100):
        some = texts[start : start + 100]
        for text, raw in zip(some, encoder.encode(some), strict=True):
            ids = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(raw, "<u4").tolist() == ids
            assert bpe.decode(encoder.vocabulary, ids) == library.decode(ids, skip_special_tokens=False) == text


def test_long_words_equal_short_ones(encoder):
    vocabulary = encoder.vocabulary
    words = [b"internationalisation", b"aaaaaaaaaaa", "ñandúéé".encode(), b"x"]
    for word, raw in zip(words, vocabulary.encode_rows(words), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == vocabulary.encode_long(word)


def test_cut_off_bytes_decode_as_the_library_does(library, encoder):
    ids = library.encode("é👍", add_special_tokens=False).ids
    for end in range(len(ids)):
        assert bpe.decode(encoder.vocabulary, ids[:end]) == library.decode(ids[:end], skip_special_tokens=False)


def test_operators_on_odd_rows(spark, library):
    rows = [(1, "ids and text", 0), (1, "ids and text", 0), (None, None, 1), (2, "", 2), (3, "long " * 30_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    tokens = bpe.encoded(docs, PATH)
    wanted = [library.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows]
    assert sorted((r.ids for r in tokens.collect()), key=len) == sorted(wanted, key=len)
    back = bpe.decoded(tokens, PATH).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t, _ in rows)
    assert sorted(r.n_tokens for r in bpe.digests(docs, PATH).collect()) == sorted(map(len, wanted))
    assert bpe.digests(docs.limit(0), PATH).collect() == []
