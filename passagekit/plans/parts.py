"""Cut ordered groups into numbered parts of bounded size, exactly and in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounded_parts(
    rows: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    cell: Column,
    max_rows: int,
    copies: Column | None = None,
    overlap: int = 0,
    size: Column | None = None,
) -> DataFrame:
    """One row per distinct (``by``, ``order``) and part, with its copies in that part.

    Within each ``by`` group the rows are numbered in ``order``; part ``p`` holds
    numbers ``p * max_rows`` up to the next multiple. Output columns are ``by``,
    ``order``, ``part`` and ``copies``. With an ``overlap`` each part begins with that many
    of the last rows of the part before, and still holds ``max_rows`` at most.

    ``cell`` is a coarse version of the leading order column: it must not
    decrease when the order increases, and a group must have a moderate number
    of cells. Neither ``by`` nor ``cell`` may be null. ``copies`` says how often
    an input row counts, once if it is not given. With a ``size``, a positive whole number that
    follows from ``order``, rows are measured by it in place of counted: a part holds the rows that begin
    within its ``max_rows`` units, so it ends with the row that fills it, and a row larger than a
    part leaves the numbers unused that it spans. Sized parts have no overlap. A further column
    ``parts`` then has the number of the group's last part plus one.

    Equal rows are folded into one with a count before anything is shuffled on
    the group, cell totals give each cell its first number, and numbering
    inside a cell needs only that cell. No task sees a whole group.
    """
    if size is not None and overlap:
        raise ValueError("sized parts have no overlap")
    keys = [*by, "_cell"]
    units = F.lit(1) if size is None else size
    folded = (
        rows.groupBy(*by, *order)
        .agg((F.count(F.lit(1)) if copies is None else F.sum(copies)).alias("copies"))
        .withColumn("_cell", cell)
    )
    earlier_cells = (
        Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    ).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cell_starts = (
        folded.groupBy(*keys)
        .agg(F.sum(F.col("copies") * units).alias("_in_cell"))
        .withColumn("_cell_start", F.coalesce(F.sum("_in_cell").over(earlier_cells), F.lit(0)))
        .withColumn("_total", F.sum("_in_cell").over(earlier_cells.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select(*keys, "_cell_start", "_total")
    )
    earlier_in_cell = (
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = folded.withColumn(
        "_offset", F.coalesce(F.sum(F.col("copies") * units).over(earlier_in_cell), F.lit(0))
    ).alias("ranked")
    starts = cell_starts.alias("starts")
    same_cell = F.lit(True)
    for name in keys:
        same_cell = same_cell & (F.col(f"ranked.{name}") == F.col(f"starts.{name}"))
    if size is not None:
        return _sized_parts(ranked.join(starts, same_cell), [*by, *order], size, max_rows)
    first = F.col("_first")
    last = F.col("_first") + F.col("copies") - 1
    step = max_rows - overlap
    part_of = lambda number: F.floor(number / F.lit(step))
    part_start = F.col("part") * F.lit(step)
    # The first part that still holds a row, then the last that begins with it.
    first_part = F.greatest(part_of(first - overlap), F.lit(0)) if overlap else part_of(first)
    return (
        ranked.join(starts, same_cell)
        .select(
            *[F.col(f"ranked.{name}") for name in (*by, *order)],
            "copies",
            (F.col("_cell_start") + F.col("_offset")).alias("_first"),
        )
        .withColumn("part", F.explode(F.sequence(first_part, part_of(last))))
        .select(
            *by,
            *order,
            "part",
            (
                F.least(last + 1, part_start + F.lit(max_rows)) - F.greatest(first, part_start)
            ).cast("int").alias("copies"),
        )
    )


def _sized_parts(placed: DataFrame, columns: Sequence[str], size: Column, max_size: int) -> DataFrame:
    """The parts in which the copies of each row begin, copy ``k`` at ``_first + k * size``."""
    first, part = F.col("_first"), F.col("part")
    number = lambda at: F.floor(at / F.lit(max_size)).cast("long")
    # Copies that begin before a place, all of them at most.
    before = lambda at: F.least(
        F.greatest(F.ceil((at - first) / F.col("_size")).cast("long"), F.lit(0)), F.col("copies").cast("long")
    )
    return (
        placed.select(
            *[F.col(f"ranked.{name}") for name in columns],
            "copies",
            size.cast("long").alias("_size"),
            (F.col("_cell_start") + F.col("_offset")).alias("_first"),
            (number(F.col("_total") - 1) + 1).alias("parts"),
        )
        .withColumn("part", F.explode(F.sequence(number(first), number(first + F.col("_size") * (F.col("copies") - 1)))))
        .withColumn("copies", (before((part + 1) * F.lit(max_size)) - before(part * F.lit(max_size))).cast("int"))
        .where(F.col("copies") > 0)
        .select(*columns, "part", "copies", "parts")
    )
