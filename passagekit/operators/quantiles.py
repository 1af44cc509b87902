"""Exact quantiles of large groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rank error of an approximate quantile is at most 1 / SKETCH_ACCURACY.
SKETCH_ACCURACY = 10_000

# Parts into which the distinct values of a group are dealt for joins on the group.
SALTS = 32
SALT = "_salt"

# Cells of a factor of two among the first cells, and cells that one of those is cut into.
# A first cell holds fewer than 2^48 doubles, so that what is left in a cell of a cell is
# bounded whatever the data, and a millionth of the first cell if its values are spread.
OCTAVE_CELLS = 16
CELLS = 2**20


def salted(weights: DataFrame, y: str = "y") -> DataFrame:
    """Values with the part of their group that they are dealt to."""
    return weights.withColumn(SALT, F.pmod(F.xxhash64(y), F.lit(SALTS)).cast("int"))


def for_all_salts(groups: DataFrame) -> DataFrame:
    """A table of one row per group, repeated for every part of it."""
    return groups.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def value_weights(df: DataFrame, by: Sequence[str], y: str) -> DataFrame:
    """Distinct values per group as doubles with their number of rows ``n``.

    Null and not a number are left out.
    """
    return (
        df.where(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")))
        .groupBy(*by, F.col(y).cast("double").alias("y"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _first_cell(y: Column) -> Column:
    """A whole number that does not decrease when ``y`` increases, of a few ten thousand in all.

    Logarithms of doubles do not decrease when these increase, rounded as they are.
    """
    # The least double has a logarithm of -1074, an infinite one counts as 1025.
    size = F.least(F.log2(F.abs(y)), F.lit(1025.0)) + 1100
    cell = F.floor(size * OCTAVE_CELLS)
    return F.when(y > 0, cell).when(y < 0, -cell).otherwise(F.lit(0)).cast("long")


def _cell_within(y: Column, low: Column, high: Column, cells: int) -> Column:
    """The number of the cell among ``cells`` equal ones from ``low`` to ``high``, both finite or equal."""
    share = (y - low) * cells / F.nullif(high - low, F.lit(0.0))
    return F.coalesce(F.least(F.floor(share), F.lit(cells - 1)), F.lit(0)).cast("long")


def _holding(cells: DataFrame, within: Sequence[str], cell: str, targets: Column) -> DataFrame:
    """The cells that hold a wanted row, with ``targets`` numbered from the cell's first row.

    ``targets`` are structs with a ``row``, numbered from 0 within ``within``. Cells are added up
    in the order of ``cell``; their number is bounded, however many rows they have.
    """
    up_to = Window.partitionBy(*within).orderBy(cell).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.col("_through") - F.col("_n")
    here = F.transform(
        F.filter(targets, lambda t: (t["row"] >= first) & (t["row"] < F.col("_through"))),
        lambda t: t.withField("row", t["row"] - first),
    )
    return (
        cells.withColumn("_through", F.sum("_n").over(up_to))
        .withColumn("_targets", here)
        .where(F.size("_targets") > 0)
        .drop("_through", "_n")
    )


def _totals(values: DataFrame, keys: Sequence[str], *others: Column) -> DataFrame:
    return values.groupBy(*keys).agg(
        F.sum("n").alias("_n"), F.min("y").alias("_low"), F.max("y").alias("_high"), *others
    )


def _inside(values: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The values of the given cells, with what these carry."""
    left, right = salted(values).alias("left"), for_all_salts(cells).alias("right")
    same = reduce(and_, [F.col(f"left.{name}") == F.col(f"right.{name}") for name in (*keys, SALT)])
    return left.join(right, same).select(
        *[F.col(f"left.{name}") for name in keys], "y", "n", *[F.col(f"right.{c}") for c in ("_low", "_high", "_targets")]
    )


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    y: str,
    probs: Sequence[float],
    cells: int = CELLS,
) -> DataFrame:
    """Linearly interpolated quantiles of ``y`` per group, as columns ``q0``, ``q1``, ...

    Rows without a group are left out. The quantile at position ``p * (rows - 1)`` of the sorted
    group lies between two rows, which are found by narrowing down. The values of a
    group are added up in cells by their size, some ten thousand; the cells that hold a wanted row are cut
    into ``cells`` equal parts and added up again. Only what is left in the wanted parts is
    sorted. Values meet the cells of their group in ``SALTS`` parts, so that a hot group or cell is no single
    task. Group columns must not be named ``y`` or ``n`` or begin with an underscore.
    """
    if not by:
        raise ValueError("exact_quantiles needs at least one group column")
    values = value_weights(df.dropna(subset=list(by)), by, y)
    values = values.withColumn("_c0", _first_cell(F.col("y")))
    position = lambda p: F.lit(float(p)) * (F.col("_rows") - 1)
    targets = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.lit(side).alias("side"),
                (position(p) - F.floor(position(p))).alias("share"),
                (F.floor if side == 0 else F.ceil)(position(p)).cast("long").alias("row"),
            )
            for i, p in enumerate(probs)
            for side in (0, 1)
        ]
    )
    totals = _totals(values, [*by, "_c0"]).withColumn("_rows", F.sum("_n").over(Window.partitionBy(*by)))
    wanted = _holding(totals, by, "_c0", targets).drop("_rows")
    inside = _inside(values, wanted, [*by, "_c0"])
    inside = inside.withColumn("_c1", _cell_within(F.col("y"), F.col("_low"), F.col("_high"), cells))
    keys = [*by, "_c0", "_c1"]
    totals = _totals(inside, keys, F.first("_targets").alias("_of_cell"))
    wanted = _holding(totals, [*by, "_c0"], "_c1", F.col("_of_cell")).drop("_of_cell")
    inside = _inside(inside.select(*keys, "y", "n"), wanted, keys)
    up_to = Window.partitionBy(*keys).orderBy("y").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    through = F.col("_through")
    found = (
        inside.withColumn("_through", F.sum("n").over(up_to))
        .select(
            *by,
            "y",
            F.inline(F.filter("_targets", lambda t: (t["row"] < through) & (t["row"] >= through - F.col("n")))),
        )
        .groupBy(*by)
    )

    def quantile(i: int) -> Column:
        lower, upper = (F.max(F.when((F.col("i") == i) & (F.col("side") == side), F.col("y"))) for side in (0, 1))
        share = F.max(F.when(F.col("i") == i, F.col("share")))
        return F.when(lower == upper, lower).otherwise(lower + (upper - lower) * share)

    return found.agg(*[quantile(i).alias(f"q{i}") for i in range(len(probs))])
