"""Whitened embeddings: the leading eigenvectors by Chebyshev-filtered subspace iteration.

The covariance is never formed. Each pass over the vectors centres them and multiplies
XᵀXQ for a block Q of a few columns, task by task. A round takes a Chebyshev polynomial of the
covariance, built by its three-term recurrence from one pass a degree, that is small on
the unwanted end of the spectrum and grows quickly above it; the block is then made
orthonormal by QR and rotated by Rayleigh-Ritz. Rounds go on until the residuals of the wanted
components certify them, or cannot fall any more for rounding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.llm.common import import_on_workers, saved, table

COMPONENTS = 8
#: Columns of the block beyond the wanted ones; they keep the filter's edge away from these.
GUARD = 16
DEGREE = 8
MAX_ROUNDS = 60
#: Residual, as a share of the greatest eigenvalue, that certifies a component.
TOLERANCE = 1e-13
#: Rounds without a smaller residual after which rounding is taken as its cause, if it is this small.
STALLED, ROUNDING = 3, 1e-11
#: Fixed values of the integer vectors: steps of a unit, and what is added.
STEPS, SHIFT = 1024, 100_000
#: Columns that the result adds to those kept.
RESULT = ("n", "deviation", "whitened", "explained", "identity_error")
#: Entries are exact as doubles below this.
EXACT = 2**52


def usable(vector: str) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.col(vector).isNotNull() & fine


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The integer vectors of a batch, one in a row."""
    if len(column) and not (np.diff(column.offsets.to_numpy()) == width).all():
        raise ValueError(f"not all vectors have {width} entries")
    entries = np.floor(column.flatten().to_numpy().astype(np.float64) * STEPS)
    if len(entries) and np.abs(entries).max() >= EXACT - SHIFT:
        raise OverflowError("an entry of a vector exceeds 52 bits")
    return (entries.astype(np.int64) + SHIFT).reshape(len(column), width)


@dataclass
class Moments:
    """Number of vectors, exact sums by dimension, and the trace of the covariance."""

    n: int
    sums: list[int]
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - sums / n``, rounded once: the whole numbers ``n * x - sums`` are divided last."""
        mean = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([s % self.n for s in self.sums], dtype=np.float64)
        return (x - mean).astype(np.float64) - rest / self.n


def moments(vectors: DataFrame, vector: str, width: int) -> Moments:
    """First pass: exact sums of values and squares. Each task sends one row for each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, [0] * width, [0] * width
        for batch in batches:
            x = _matrix(batch.column(0), width)
            n += len(x)
            # Sums that could exceed 64 bits are taken of Python's whole numbers.
            exact = x if int(np.abs(x).max(initial=0)) ** 2 * len(x) < 2**62 else x.astype(object)
            sums = [a + int(b) for a, b in zip(sums, exact.sum(axis=0), strict=True)]
            squares = [a + int(b) for a, b in zip(squares, (exact * exact).sum(axis=0), strict=True)]
        if n:
            whole = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(width), pa.int32()),
                    pa.array([n] * width, pa.int64()),
                    pa.array(map(Decimal, sums), whole),
                    pa.array(map(Decimal, squares), whole),
                ],
                names=["at", "n", "total", "squares"],
            )

    parts = vectors.select(vector).mapInArrow(add, "at int, n long, total decimal(38,0), squares decimal(38,0)")
    rows = parts.groupBy("at").agg(F.sum("n"), F.sum("total"), F.sum("squares")).collect()
    rows.sort()
    n = rows[0][1] if rows else vectors.count()
    sums, squares = [int(r[2]) for r in rows], [int(r[3]) for r in rows]
    spread = sum(n * q - s * s for q, s in zip(squares, sums, strict=True))
    return Moments(n, sums, spread / (n * n) if n else 0.0)


def _summed(vectors: DataFrame, vector: str, known: Moments, of, rows: int, columns: int) -> np.ndarray:
    """The sum over all batches of ``of(centred batch)``, a matrix of the given size.

    A task adds its batches up and sends one row for each row of the matrix.
    """
    width = len(known.sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros((rows, columns)), False
        for batch in batches:
            if batch.num_rows:
                any_rows = True
                total += of(known.centred(_matrix(batch.column(0), width)))
        if any_rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(rows), pa.int32()), *(pa.array(c) for c in total.T.copy())],
                names=["at", *(f"c{j}" for j in range(columns))],
            )

    schema = ", ".join(["at int", *(f"c{j} double" for j in range(columns))])
    parts = vectors.select(vector).mapInArrow(add, schema)
    found = parts.groupBy("at").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(columns)]).collect()
    matrix = np.zeros((rows, columns))
    for row in found:
        matrix[row[0]] = row[1:]
    return matrix


def leading_components(
    vectors: DataFrame, vector: str, known: Moments, wanted: int = COMPONENTS, guard: int = GUARD
) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors, in columns, of the covariance of the integer vectors.

    Eigenvalues that rounding can't tell from zero are left out, so there may be fewer than ``wanted``.
    """
    width = len(known.sums)
    size = min(width, wanted + guard)
    wanted = min(wanted, width)

    def multiply(q: np.ndarray) -> np.ndarray:
        """The covariance times ``q``, by one pass over the vectors."""
        return _summed(vectors, vector, known, lambda x: x.T @ (x @ q), *q.shape) / known.n

    if known.trace <= 0:
        return np.zeros(0), np.zeros((width, 0))
    start = np.eye(width) if size == width else np.random.default_rng(0).standard_normal((width, size))
    q = np.linalg.qr(start)[0]
    least, stalled = np.inf, 0
    for _ in range(MAX_ROUNDS):
        values, q, residuals = _rayleigh_ritz(q, multiply(q), wanted)
        kept = values[:wanted] > known.trace * width * 1e-15
        worst = float(residuals[kept].max(initial=0)) / values[0]
        stalled = 0 if worst < 0.9 * least else stalled + 1
        least = min(least, worst)
        if worst <= TOLERANCE or size == width or (stalled >= STALLED and least <= ROUNDING):
            return values[:wanted][kept], q[:, :wanted][:, kept]
        # The unwanted end reaches from zero to the least of the block.
        q = np.linalg.qr(_filtered(multiply, q, max(values[-1], values[0] * 1e-12), values[0]))[0]
    raise ArithmeticError(f"components are not certified after {MAX_ROUNDS} rounds: residual {least:.1e}")


def _rayleigh_ritz(q: np.ndarray, image: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, falling, their vectors, and the residuals of the wanted ones."""
    small = q.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors, images = q @ turn, image @ turn
    return values, vectors, np.linalg.norm(images - vectors * values, axis=0)[:wanted]


def _filtered(multiply, q: np.ndarray, edge: float, top: float) -> np.ndarray:
    """The Chebyshev polynomial of degree ``DEGREE`` for the interval from 0 to ``edge``, scaled at ``top``."""
    centre = half = edge / 2
    scale = half / (top - centre) if top > centre else 1.0
    first = scale
    before, now = q, (multiply(q) - centre * q) * (scale / half)
    for _ in range(DEGREE - 1):
        next_scale = 1 / (2 / first - scale)
        before, now = now, (multiply(now) - centre * now) * (2 * next_scale / half) - scale * next_scale * before
        scale = next_scale
    return now


def whitened(
    df: DataFrame, vector: str = "embedding", wanted: int = COMPONENTS, keep: tuple[str, ...] = ("vec_id",)
) -> DataFrame:
    """``keep``, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error`` of each usable vector.

    ``whitened`` and ``explained`` are arrays with one number a component, by falling eigenvalue.
    Rows whose vector is null or holds a null or not finite entry are left out. All others count,
    repeated ones and those with a null id too. ``deviation`` is an exact whole number,
    decimal(38, 0). Components without any variance cannot be scaled and are left out, so equal
    vectors, a single vector and empty ones have empty arrays. Vectors of different lengths raise an
    error, as do entries of 2^52 / 1024 and more. Other columns than ``keep`` are left out; kept ones that
    are named as a column of the result raise ``ValueError``.
    """
    if clash := {"_vector", *RESULT} & set(keep):
        raise ValueError(f"the result has columns {sorted(clash)} of its own")
    spark = df.sparkSession
    import_on_workers(spark)
    rows = df.where(usable(vector)).select(*keep, F.col(vector).cast("array<double>").alias("_vector"))
    # Read by every pass, so the usable vectors are written once.
    rows = saved(rows.select(*keep, "_vector"))
    width = rows.agg(F.max(F.size("_vector"))).first()[0] or 0
    known = moments(rows, "_vector", width)
    values, vectors = leading_components(rows, "_vector", known, wanted) if width else (np.zeros(0), np.zeros((0, 0)))
    scaled = vectors / np.sqrt(values)
    k = len(values)
    error = 0.0
    if k:
        # A column of ones beside the whitened values gives their sums along with their products.
        both = lambda w: np.vstack([w.T @ w, w.sum(axis=0)])
        products = _summed(rows, "_vector", known, lambda x: both(x @ scaled), k + 1, k) / known.n
        error = float(np.abs(products[:k] - np.outer(products[k], products[k]) - np.eye(k)).max())
    n, sums = known.n, known.sums
    deviation_type, number_type = pa.decimal128(38, 0), pa.list_(pa.float64())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["_vector"], width)
            exact = x.astype(object) * n - np.array(sums, dtype=object)
            if len(x) and width:
                largest = int(np.abs(exact).max())
                exact = exact.astype(np.int64) if largest * largest * width < 2**63 else exact
            deviations = [Decimal(int(d)) for d in (exact * exact).sum(axis=1)]
            w = known.centred(x) @ scaled if k else np.zeros((len(x), 0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(deviations, deviation_type), pa.array(list(w), number_type)],
                names=[*batch.schema.names[:-1], "deviation", "whitened"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    found = rows.mapInArrow(project, f"{schema}, deviation decimal(38,0), whitened array<double>")
    return found.select(
        *keep,
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*[F.lit(float(v / known.trace)) for v in values]).cast("array<double>").alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each usable embedding and component."""
    found = whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("_at", "_of")
    return found.select("vec_id", each, "n", F.col("deviation").cast("long").alias("deviation"), "identity_error").select(
        "vec_id",
        (F.col("_at") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        "_of.whitened",
        "_of.explained",
        "identity_error",
    )
