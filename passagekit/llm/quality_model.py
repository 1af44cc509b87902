"""Quality classifier: a generalised additive model with pairwise interactions.

Features are cut into bins. Boosting goes through them in a cycle, each time fitting a
shallow tree of one feature to what is left of the labels and adding a small part of it to
that feature's table of one number per bin. The pairs of features that explain most of the rest
then get tables of two dimensions in the same way. A document's score is the sum of the
numbers at its bins, as a probability.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.llm.common import id_remainder, import_on_workers, table, text_of, utf8_of
from passagekit.llm.quality_rules import Batch, _some, duplicate_lines, symbols

#: Labelled rows the model is fitted on; more are chosen by the hash of their id.
MAX_EXAMPLES = 20_000
BINS = 32
PAIR_BINS = 8
ROUNDS = 120
PAIRS = 6
PAIR_ROUNDS = 40
RATE = 0.1
LEAVES = 4
#: Weight that a leaf must have before it is split off (sum of p(1-p)).
MIN_WEIGHT = 1.0
#: Added to a leaf's weight, so that few examples move little.
RIDGE = 1.0
CUT = 0.7

FEATURES = (
    "log_words",
    "word_bytes",
    "symbols",
    "capitals",
    "exclamations",
    "bars",
    "digits",
    "points",
    "lines",
    "duplicate_lines",
    "repeated_words",
    "distinct_words",
)
_CAPITALS = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123)])
_DIGITS = b"0123456789"


def _count(text: bytes, which: bytes) -> int:
    return len(text) - len(text.translate(None, which))


def features(texts: list[bytes]) -> np.ndarray:
    """One row of :data:`FEATURES` for each text; a text without words has zeros."""
    batch = Batch(texts)
    words = batch.n_words.astype(float)
    per_word = 1 / np.maximum(words, 1)
    size = np.fromiter(map(len, texts), dtype=float, count=len(texts))
    per_byte = 1 / np.maximum(size, 1)

    def counted(of) -> np.ndarray:
        return np.fromiter(map(of, texts), dtype=float, count=len(texts))

    distinct = np.fromiter((len(set(ws)) for ws in batch.words), dtype=float, count=len(texts))
    lines = counted(lambda t: t.count(b"\n")) + (words > 0)
    letters = np.maximum(counted(lambda t: _count(t, _LETTERS)), 1)
    spaces = counted(lambda t: _count(t, b" \t\n\r\x0b\x0c"))
    return np.stack(
        [
            np.log1p(words),
            (size - spaces) * per_word,
            counted(symbols) * per_byte,
            counted(lambda t: _count(t, _CAPITALS)) / letters,
            counted(lambda t: t.count(b"!")) * per_word,
            counted(lambda t: t.count(b"|")) * per_word,
            counted(lambda t: _count(t, _DIGITS)) * per_byte,
            counted(lambda t: t.count(b".")) * per_word,
            lines * per_word,
            counted(duplicate_lines) / np.maximum(lines, 1),
            batch.repeated_words() * per_word,
            distinct * per_word,
        ],
        axis=1,
    )


@dataclass
class Model:
    """Bin limits and tables; ``pairs`` maps two feature numbers to a table."""

    limits: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: list[np.ndarray]
    intercept: float
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        total = np.full(len(rows), self.intercept)
        for f, (limits, values) in enumerate(zip(self.limits, self.tables, strict=True)):
            total += values[_bins(rows[:, f], limits)]
        for (a, b), values in self.pairs.items():
            total += values[_bins(rows[:, a], self.coarse[a]), _bins(rows[:, b], self.coarse[b])]
        return _probability(total)


def _bins(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    return np.searchsorted(limits, values, side="left")


def _probability(total: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _limits(values: np.ndarray, bins: int) -> np.ndarray:
    """Bin limits: midway between few distinct values, else at quantiles.

    Half of those are quantiles of the rows and half of the distinct values, so that a
    rare tail is seen too.
    """
    distinct = np.unique(values)
    if len(distinct) <= bins:
        return (distinct[1:] + distinct[:-1]) / 2
    inner = np.linspace(0, 1, bins // 2 + 1)[1:-1]
    return np.unique(np.concatenate([np.quantile(values, inner), np.quantile(distinct, inner)]))


def _gain(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return gradient**2 / (weight + RIDGE)


def shallow_tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Leaf values by bin of a tree of at most ``leaves`` leaves over ordered bins.

    The leaf with the best split is split first; sums by bin are all it needs.
    """
    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for part in parts:
            g, w = gradient[slice(*part)], weight[slice(*part)]
            left_g, left_w = np.cumsum(g)[:-1], np.cumsum(w)[:-1]
            right_g, right_w = g.sum() - left_g, w.sum() - left_w
            gain = _gain(left_g, left_w) + _gain(right_g, right_w) - _gain(g.sum(), w.sum())
            gain[(left_w < MIN_WEIGHT) | (right_w < MIN_WEIGHT)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), part, part[0] + 1 + int(gain.argmax()))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    values = np.zeros(len(gradient))
    for part in parts:
        values[slice(*part)] = gradient[slice(*part)].sum() / (weight[slice(*part)].sum() + RIDGE)
    return values


def shallow_grid(gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Values by cell of the best tree with one cut on one feature and one on the other in each half, and its gain."""
    best, values = 0.0, np.zeros_like(gradient)
    for axis in (0, 1):
        g, w = (gradient, weight) if axis == 0 else (gradient.T, weight.T)
        for cut in range(1, len(g)):
            gain, found = 0.0, np.zeros_like(g)
            for half in (slice(0, cut), slice(cut, None)):
                leaf = shallow_tree(g[half].sum(axis=0), w[half].sum(axis=0), 2)
                found[half] = leaf
                gain += float((leaf * g[half].sum(axis=0)).sum())
            if gain > best + 1e-12:
                best, values = gain, found if axis == 0 else found.T
    return values, best


def fit(rows: np.ndarray, labels: np.ndarray) -> Model:
    """Fit the model to rows of features and labels 0 or 1.

    Without examples of both labels the score is the constant (ones + 1) / (examples + 1),
    so that without any evidence nothing is rejected. The result depends on the rows only, not on chance.
    """
    ones, n = float(labels.sum()), len(labels)
    limits = [_limits(rows[:, f], BINS) if n else np.array([]) for f in range(len(FEATURES))]
    coarse = [_limits(rows[:, f], PAIR_BINS) if n else np.array([]) for f in range(len(FEATURES))]
    tables = [np.zeros(len(x) + 1) for x in limits]
    if ones in (0, n):
        share = min((ones + 1) / (n + 1), 1 - 1e-9)
        return Model(limits, coarse, tables, float(np.log(share / (1 - share))))
    model = Model(limits, coarse, tables, float(np.log(ones / (n - ones))))
    binned = [_bins(rows[:, f], limits[f]) for f in range(len(FEATURES))]
    total = np.full(n, model.intercept)
    for _ in range(ROUNDS):
        for at, values in zip(binned, tables, strict=True):
            p = _probability(total)
            step = RATE * shallow_tree(*_sums(at, labels - p, p * (1 - p), len(values)))
            values += step
            total += step[at]
    cells = {}
    for a, b in combinations(range(len(FEATURES)), 2):
        shape = len(coarse[a]) + 1, len(coarse[b]) + 1
        cells[a, b] = _bins(rows[:, a], coarse[a]) * shape[1] + _bins(rows[:, b], coarse[b]), shape
    p = _probability(total)
    gains = {pair: shallow_grid(*_grid(at, labels - p, p * (1 - p), shape))[1] for pair, (at, shape) in cells.items()}
    chosen = sorted(gains, key=lambda pair: (-gains[pair], pair))[:PAIRS]
    model.pairs = {pair: np.zeros(cells[pair][1]) for pair in chosen}
    for _ in range(PAIR_ROUNDS):
        for pair, values in model.pairs.items():
            at, shape = cells[pair]
            p = _probability(total)
            step = RATE * shallow_grid(*_grid(at, labels - p, p * (1 - p), shape))[0]
            values += step
            total += step.ravel()[at]
    return model


def _sums(at: np.ndarray, gradient: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.bincount(at, weights=gradient, minlength=n), np.bincount(at, weights=weight, minlength=n)


def _grid(at, gradient, weight, shape) -> tuple[np.ndarray, np.ndarray]:
    first, second = _sums(at, gradient, weight, shape[0] * shape[1])
    return first.reshape(shape), second.reshape(shape)


def _features_of(text_col: str) -> Column:
    @F.arrow_udf("array<double>")
    def of(column: pa.Array) -> pa.Array:
        found = [features(texts) for texts, _ in _some((v.as_py() for v in column), range(len(column)))]
        rows = np.concatenate(found) if found else np.zeros((0, len(FEATURES)))
        ends = pa.array(np.arange(len(rows) + 1) * len(FEATURES), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))

    return of(utf8_of(text_col))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_examples: int = MAX_EXAMPLES,
) -> Model:
    """Fit the model to ``labels`` (``id_col`` and ``label_col``, 0 or 1) of ``docs``.

    At most ``max_examples`` labelled ids that a document has are used, those with the smallest hashes; other
    labels than 0 and 1 and null ids are left out. Of repeated rows with one id, label and text one
    counts, and of those examples at most ``max_examples``, by id; only their features reach the driver.
    """
    import_on_workers(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    known = known.join(docs.select(F.col(id_col).alias("_id")), "_id", "left_semi")
    known = known.distinct().orderBy(F.xxhash64("_id"), "_id", "_label").limit(max_examples)
    # The sample is bounded, so it goes to all tasks and the documents stay where they are.
    found = docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(known), F.col(id_col) == F.col("_id"))
    found = found.select("_id", "_label", F.xxhash64(text_of(text_col)).alias("_hash"), _features_of(text_col).alias("_features"))
    single = found.groupBy("_id", "_label", "_hash").agg(F.first("_features").alias("_features"))
    rows = single.orderBy("_id", "_label", "_hash").limit(max_examples).collect()
    x = np.array([r[3] for r in rows]).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r[1] for r in rows], dtype=float))


def score(model: Model, text_col: str = "text") -> Column:
    """Probability of label 1 of a text column; null counts as the empty text."""

    @F.arrow_udf("double")
    def of(column: pa.Array) -> pa.Array:
        found = [model.score(features(texts)) for texts, _ in _some((v.as_py() for v in column), range(len(column)))]
        return pa.array(np.concatenate(found) if found else [], pa.float64())

    return of(utf8_of(text_col))


def with_score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    out_col: str = "quality_score",
    examples: DataFrame | None = None,
) -> DataFrame:
    """``docs`` with the probability ``out_col`` that a text is of good quality.

    The labelled texts are looked up in ``examples``, by default in ``docs``. Labels whose id is held out (``crc32`` of the id as text modulo 4 is 2) are not learned.
    Equal texts get equal scores, empty and null ones too; other columns stay as they are.
    """
    model = train(docs if examples is None else examples, labels.where(~held_out(id_col)), id_col, text_col, label_col)
    return docs.withColumn(out_col, score(model, text_col))


def held_out(id_col: str = "doc_id") -> Column:
    return id_remainder(id_col, 4) == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of ``labels.quality``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_score(docs, table(spark, sf_dir, "labels"), out_col="score")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
