"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is the set of its words, their beginnings, neighbouring word pairs and pairs with one or two
words between, each hashed to one of ``COORDINATES`` numbers. The weights are learned online: every coordinate
has its own rate, which falls with the squared gradients that it has seen, and an L1 penalty
keeps all weights at zero that the labels do not need.

Learning is spread over ``SHARDS`` streams of examples. In each round a task goes through
its stream from the common state, and the changes of a coordinate are averaged over the streams
that met it. The state has a fixed size; only the weights that are not zero go to the
tasks that score, as two arrays.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.llm.common import id_remainder, import_on_workers, saved, table, utf8_of

#: Labelled texts that are learned from; of more, those with the smallest hashes are taken.
MAX_EXAMPLES = 20_000
COORDINATES = 2**19
#: Numbers of words between the two of a skip-gram.
SKIPS = (1, 2)
#: Characters of the beginnings that longer words count by as well, so that inflected forms share a weight.
BEGINNINGS = (4, 5, 6)
SHARDS = 4
ROUNDS = 4
#: FTRL-proximal: learning rate and its damping, L1 and L2 penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 2.0, 0.1
CUT = 0.5
#: Changes are summed as whole numbers of this unit, so that their order is of no account.
UNIT = 2.0**-20

#: Runs of letters and digits.
_WORD = re.compile(r"[^\W_]+")


def features(text: bytes) -> np.ndarray:
    """The distinct coordinates of a text in UTF-8, in rising order; none without a word.

    Words are runs of letters and digits in lower case.
    """
    words = _WORD.findall(text.decode("utf-8", "replace").lower())
    known = {word: zlib.crc32(word.encode()) for word in set(words)}
    starts = {word[:size] for word in known for size in BEGINNINGS if len(word) > size}
    hashes = _numbers([known[word] for word in words])
    found = [_mixed(_numbers(known.values()), 0), _mixed(_numbers([zlib.crc32(w.encode()) for w in starts]), 1)]
    for kind, gap in enumerate((0, *SKIPS), start=2):
        first, second = hashes[: -gap - 1], hashes[gap + 1 :]
        found.append(_mixed(first * np.uint64(0x9E3779B1) + second, kind))
    return np.unique(np.concatenate(found)).astype(np.int32)


def packed(coordinates: np.ndarray) -> bytes:
    """Rising coordinates as compressed steps, a fraction of their size."""
    return zlib.compress(np.diff(coordinates, prepend=0).astype("<u4").tobytes(), 1)


def unpacked(steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(steps), "<u4").astype(np.int32))


def _numbers(values) -> np.ndarray:
    return np.fromiter(values, dtype=np.uint64, count=len(values))


def _mixed(values: np.ndarray, kind: int) -> np.ndarray:
    """Coordinates of whole numbers, another one for each kind of feature."""
    x = values + np.uint64(kind << 59)
    for shift in (np.uint64(32), np.uint64(29)):
        x = (x ^ (x >> shift)) * np.uint64(0xFF51AFD7ED558CCD)
    return (x >> np.uint64(40)) % np.uint64(COORDINATES)


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights of a state: zero within the L1 penalty, else the closed form of the proximal step."""
    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def _probability(total):
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


class Ftrl:
    """State of the regression: ``z`` and ``n`` of each coordinate, the last one being the constant."""

    def __init__(self, z: np.ndarray | None = None, n: np.ndarray | None = None):
        self.z = np.zeros(COORDINATES + 1) if z is None else z.astype(float)
        self.n = np.zeros(COORDINATES + 1) if n is None else n.astype(float)

    def learn(self, coordinates: np.ndarray, label: int) -> None:
        """One step on one example."""
        at = np.append(coordinates, COORDINATES)
        z, n = self.z[at], self.n[at]
        w = weights_of(z, n)
        # The constant is not held at zero.
        w[-1] = -z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA + L2)
        gradient = _probability(w.sum()) - label
        grown = n + gradient * gradient
        self.z[at] = z + gradient - (np.sqrt(grown) - np.sqrt(n)) / ALPHA * w
        self.n[at] = grown


class Model:
    """The weights that are not zero, by coordinate, and the constant."""

    def __init__(self, z: np.ndarray, n: np.ndarray):
        weights = weights_of(z, n)[:-1]
        self.coordinates = np.nonzero(weights)[0].astype(np.int32)
        self.weights = weights[self.coordinates]
        self.constant = float(-z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA + L2))

    def dense(self) -> np.ndarray:
        whole = np.zeros(COORDINATES)
        whole[self.coordinates] = self.weights
        return whole


def examples_of(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_examples: int
) -> DataFrame:
    """``label`` and packed ``coordinates`` of at most ``max_examples`` texts, dealt into ``SHARDS`` ordered streams.

    Labels other than 0 and 1, null ids and ids that no document has are left out. Repeated
    rows of a text and label count once, and an id with both labels counts with each. All
    choices are by hash, so the streams are the same in every run.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).distinct()
    known = known.join(docs.select(F.col(id_col).alias("_id")), "_id", "left_semi")
    known = known.orderBy(F.xxhash64("_id", "label"), "_id", "label").limit(max_examples)
    texts = docs.select(F.col(id_col).alias("_id"), utf8_of(text_col).alias("_text"))
    # The chosen labels are bounded, so they go to all tasks and the texts stay where they are.
    found = texts.join(F.broadcast(known), "_id").select("label", F.xxhash64("_text", "label").alias("_hash"), "_text")
    # An id may have many texts; their hashes say which ones are within the bound.
    most = found.select("_hash").distinct().orderBy("_hash").limit(max_examples).agg(F.max("_hash")).first()[0]
    found = found.where(F.col("_hash") <= F.lit(0 if most is None else most).cast("long"))

    @F.arrow_udf("binary")
    def coordinates(column: pa.Array) -> pa.Array:
        return pa.array([packed(features(v.as_py())) for v in column], pa.binary())

    hashed = found.select("_hash", "label", coordinates("_text").alias("coordinates"))
    # Equal hashes stand for equal texts with equal labels; one row of each goes on.
    single = hashed.groupBy("_hash").agg(F.first("label").alias("label"), F.first("coordinates").alias("coordinates"))
    shard = F.pmod(F.xxhash64("_hash"), F.lit(SHARDS))
    return single.repartition(SHARDS, shard).sortWithinPartitions("_hash").select("label", "coordinates")


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_examples: int = MAX_EXAMPLES,
    rounds: int = ROUNDS,
) -> Model:
    """Learn from ``labels`` (``id_col`` and ``label_col``, 0 or 1) of ``docs``.

    Only the changed coordinates of a round reach the driver, ``COORDINATES`` at most. Without
    examples every score is a half.
    """
    import_on_workers(docs.sparkSession)
    examples = saved(examples_of(docs, labels, id_col, text_col, label_col, max_examples))
    # The common state goes to all tasks in every round, so it is kept short.
    z, n = np.zeros(COORDINATES + 1, np.float32), np.zeros(COORDINATES + 1, np.float32)
    for _ in range(rounds):
        changes = examples.mapInArrow(_stream(z, n), "coordinate int, z long, n long")
        mean = changes.groupBy("coordinate").agg(F.sum("z") / F.count("z"), F.sum("n") / F.count("n")).toArrow()
        at = mean.column(0).to_numpy()
        z[at] += (mean.column(1).to_numpy() * UNIT).astype(np.float32)
        n[at] += (mean.column(2).to_numpy() * UNIT).astype(np.float32)
    return Model(z.astype(float), n.astype(float))


def _stream(z: np.ndarray, n: np.ndarray):
    """A task's pass over its examples from the common state, giving what has changed."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Ftrl(z, n)
        for batch in batches:
            for label, coordinates in zip(batch["label"].to_pylist(), batch["coordinates"], strict=True):
                state.learn(unpacked(coordinates.as_py()), label)
        at = np.nonzero(state.n != n)[0]
        parts = (np.rint((new[at] - old[at]) / UNIT).astype(np.int64) for new, old in ((state.z, z), (state.n, n)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), *map(pa.array, parts)], names=["coordinate", "z", "n"]
        )

    return learn


def score(model: Model, text_col: str = "text") -> Column:
    """Probability that a text is toxic; null counts as the empty text, whose score is the constant's."""

    @F.arrow_udf("double")
    def of(column: pa.Array) -> pa.Array:
        weights = model.dense()
        totals = [weights[features(v.as_py())].sum() for v in column]
        return pa.array(_probability(np.array(totals, dtype=float) + model.constant))

    return of(utf8_of(text_col))


def held_out(id_col: str = "doc_id") -> Column:
    return id_remainder(id_col, 5) == 0


def with_score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    out_col: str = "toxicity",
    examples: DataFrame | None = None,
) -> DataFrame:
    """``docs`` with ``out_col``, the probability that a text is toxic; other columns stay as they are.

    Labels whose id is held out (``crc32`` of the id as text modulo 5 is 0) are not learned. The
    labelled texts are looked up in ``examples``, by default in ``docs``. Every row gets
    a score from its whole text alone, so equal texts get equal scores; null and empty texts and those
    without a word get the score of the constant, and an empty table stays empty.
    An own column named ``out_col`` raises ``ValueError``.
    """
    if out_col in docs.columns:
        raise ValueError(f"the table has a column {out_col!r} of its own")
    model = train(docs if examples is None else examples, labels.where(~held_out(id_col)), id_col, text_col, label_col)
    return docs.withColumn(out_col, score(model, text_col))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of ``labels.toxic``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_score(docs, table(spark, sf_dir, "labels"), out_col="score")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
