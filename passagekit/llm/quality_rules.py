"""Quality rules: base rules on words and lines, and a hashed n-gram likelihood ratio.

Every document's words and word pairs are hashed into a fixed number of buckets. Their
multinomial over a trusted target and that over the whole raw corpus give each document a
log-likelihood ratio, divided by its number of n-grams. A document is kept if the base rules hold
and that ratio reaches a fixed threshold; nothing is drawn at random.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.llm.common import import_on_workers, table, utf8_of

BUCKETS = 1 << 14
#: Count added to each bucket of both multinomials.
PRIOR = 1.0
#: Smallest mean log-likelihood ratio (natural logarithm, per n-gram) of a kept document.
THRESHOLD = -0.06
MIN_WORDS = 50
#: Percentage of words in repeated 3-word windows above which a document fails.
MAX_REPEATED = 50
SYMBOLS = b"#*$%&|<>"
_SECOND_BYTES = bytes(range(0x80, 0xC0))


class Batch:
    """The words of some texts as numbers: equal words of the batch have equal numbers."""

    def __init__(self, texts: list[bytes]):
        self.words = [t.split() for t in texts]
        self.n_words = np.fromiter(map(len, self.words), dtype=np.int64, count=len(texts))
        self.starts = np.concatenate([[0], np.cumsum(self.n_words)])
        flat = np.empty(int(self.starts[-1]), dtype=object)
        flat[:] = [w for ws in self.words for w in ws]
        self.codes, self.distinct = pd.factorize(flat)
        self.text_of_word = np.repeat(np.arange(len(texts)), self.n_words)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums by text of a value for each word."""
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    def repeated_words(self) -> np.ndarray:
        """Per text, the words that lie in a 3-word window found at least twice in the text."""
        n = len(self.codes)
        inside = np.zeros(n, dtype=np.int64)
        if n >= 3:
            base = np.int64(len(self.distinct) + 1)
            pairs = self.codes[:-1].astype(np.int64) * base + self.codes[1:]
            # Numbers of pairs are made dense again, so that three words can't overflow.
            _, dense = np.unique(pairs, return_inverse=True)
            windows = dense[:-1].astype(np.int64) * base + self.codes[2:]
            whole = np.nonzero(self.text_of_word[:-2] == self.text_of_word[2:])[0]
            windows, text = windows[whole], self.text_of_word[whole]
            order = np.lexsort((windows, text))
            same = (windows[order][1:] == windows[order][:-1]) & (text[order][1:] == text[order][:-1])
            twice = np.zeros(len(order), dtype=bool)
            twice[1:] |= same
            twice[:-1] |= same
            at = whole[order[twice]]
            for step in range(3):
                inside[at + step] = 1
        return self.per_text(inside)

    def n_grams(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and text of each word and of each pair of neighbouring words of a text.

        Words are hashed with A-Z lowered, so that shouting does not hide known words from the model.
        """
        distinct = np.fromiter((zlib.crc32(w.lower()) for w in self.distinct), dtype=np.uint64, count=len(self.distinct))
        hashes = distinct[self.codes]
        odd = np.uint64(0x9E3779B97F4A7C15)
        shift, mask = np.uint64(40), np.uint64(buckets - 1)
        singles = (hashes * odd >> shift) & mask
        joint = np.nonzero(self.text_of_word[:-1] == self.text_of_word[1:])[0]
        mixed = (hashes[joint] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[joint + 1] + np.uint64(1)) * odd
        pairs = (mixed >> shift) & mask
        text = np.concatenate([self.text_of_word, self.text_of_word[joint]])
        return np.concatenate([singles, pairs]).astype(np.int64), text


def code_points(word: bytes) -> int:
    """Code points of UTF-8 bytes: all bytes but those that continue one."""
    return len(word.translate(None, _SECOND_BYTES))


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(lines) - len(set(lines))


def symbols(text: bytes) -> int:
    return len(text) - len(text.translate(None, SYMBOLS))


#: Columns of the base rules, in order.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(texts: list[bytes], batch: Batch) -> list[np.ndarray]:
    sizes = np.fromiter(map(code_points, batch.distinct), dtype=np.int64, count=len(batch.distinct))
    return [
        batch.n_words,
        batch.per_text(sizes[batch.codes]),
        np.fromiter(map(symbols, texts), dtype=np.int64, count=len(texts)),
        np.fromiter(map(duplicate_lines, texts), dtype=np.int64, count=len(texts)),
        batch.repeated_words(),
    ]


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Too few words, or too large a part of them repeated."""
    n = counts["n_words"]
    return (n < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEATED * n)


#: Bytes of text whose words are numbered together.
TOGETHER = 1 << 20


def _some(values: Iterable[bytes], extra: Iterable) -> Iterator[tuple[list[bytes], list]]:
    texts, others, size = [], [], 0
    for value, other in zip(values, extra, strict=True):
        texts.append(value)
        others.append(other)
        size += len(value)
        if size > TOGETHER:
            yield texts, others
            texts, others, size = [], [], 0
    if texts:
        yield texts, others


def multinomials(docs: DataFrame, trusted: Column, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``bucket``, ``raw`` and ``target``: n-gram counts of all documents and of the trusted ones.

    A ``trusted`` of null counts as false. Each task adds its batches up before the shuffle, so
    that it sends ``buckets`` rows at most.
    """
    import_on_workers(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, buckets), dtype=np.int64)
        for whole in batches:
            values = (v.as_py() for v in whole["text"])
            for texts, flags in _some(values, whole["trusted"].to_pylist()):
                found, text = Batch(texts).n_grams(buckets)
                totals[0] += np.bincount(found, minlength=buckets)
                totals[1] += np.bincount(found[np.array(flags)[text]], minlength=buckets)
        used = np.nonzero(totals[0])[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(totals[0][used]), pa.array(totals[1][used])], names=["bucket", "raw", "target"]
        )

    chosen = docs.select(utf8_of(text_col).alias("text"), F.coalesce(trusted, F.lit(False)).alias("trusted"))
    counted = chosen.mapInArrow(count, "bucket long, raw long, target long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def ratios(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log-likelihood ratio of target and raw corpus for each bucket; all 0 without a target.

    ``counts`` has ``buckets`` rows at most, whatever the size of the corpus.
    """
    found = np.full((2, buckets), PRIOR)
    for bucket, raw, target in counts.collect():
        found[:, bucket] += raw, target
    if found[1].sum() == PRIOR * buckets:
        return np.zeros(buckets)
    shares = np.log(found / found.sum(axis=1, keepdims=True))
    return shares[1] - shares[0]


RESULT = ", ".join([*(f"{c}: bigint" for c in BASE), "base_failed: boolean", "llr: double", "kept: boolean"])


def verdict(text_col: str, weights: np.ndarray, threshold: float = THRESHOLD) -> Column:
    """Struct of the base counts, ``base_failed``, ``llr`` (0 for a text without words) and ``kept``."""
    buckets = len(weights)

    @F.arrow_udf(f"struct<{RESULT}>")
    def of(column: pa.Array) -> pa.Array:
        columns = [[] for _ in range(len(BASE) + 3)]
        for texts, _ in _some((v.as_py() for v in column), range(len(column))):
            batch = Batch(texts)
            counts = base_counts(texts, batch)
            failed = base_failed(dict(zip(BASE, counts, strict=True)))
            found, text = batch.n_grams(buckets)
            sums = np.bincount(text, weights=weights[found], minlength=len(texts))
            sizes = np.bincount(text, minlength=len(texts))
            llr = sums / np.maximum(sizes, 1)
            for whole, part in zip(columns, [*counts, failed, llr, ~failed & (llr >= threshold)], strict=True):
                whole.append(part)
        kinds = [pa.int64()] * len(BASE) + [pa.bool_(), pa.float64(), pa.bool_()]
        arrays = [pa.array(np.concatenate(c) if c else [], k) for c, k in zip(columns, kinds, strict=True)]
        return pa.StructArray.from_arrays(arrays, names=[*BASE, "base_failed", "llr", "kept"])

    return of(utf8_of(text_col))


def with_verdict(
    docs: DataFrame,
    trusted_ids: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    out_col: str = "quality_rules",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``docs`` with the struct column ``out_col``: base counts, ``base_failed``, ``llr`` and ``kept``.

    ``trusted_ids`` names the documents of the trusted target in its column ``id_col``;
    repeated or null ids there do no harm. Without any, every ratio is 0 and the base rules
    decide. A null or empty text has no words and fails the base rules. Repeated rows are judged
    alike, other columns stay as they are.
    """
    import_on_workers(docs.sparkSession)
    ids = trusted_ids.select(F.col(id_col).alias("_trusted")).where("_trusted IS NOT NULL").distinct()
    # Both grow with the corpus, so neither is broadcast; only ids are held in hash tables and no text is sorted.
    marked = docs.select(id_col, text_col).join(ids.hint("shuffle_hash"), F.col(id_col) == F.col("_trusted"), "left")
    weights = ratios(multinomials(marked, F.col("_trusted").isNotNull(), text_col))
    return docs.withColumn(out_col, verdict(text_col, weights, threshold))


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents labelled as good quality."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all documents; the target are those labelled as good quality."""
    judged = with_verdict(table(spark, sf_dir, "documents"), trusted(spark, sf_dir))
    return judged.select("doc_id", "quality_rules.*")
