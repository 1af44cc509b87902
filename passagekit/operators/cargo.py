"""Nearest cargo movement per passage."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagekit.functions.dates import as_date, within_dates
from passagekit.schemas import CARGO_COLUMNS

CARGO_TOLERANCE_DAYS = 39
JOIN_DATES = ("unload_date", "load_date")

PASSAGE_COLUMNS = ("vessel_key", "geofence", "exit_heading", "exit_direction", "passage_time")

# Columns of the matched table, in the order that its readers know.
MATCHED_COLUMNS = (
    "vessel_key",
    "geofence",
    "exit_heading",
    "exit_direction",
    "date_diff",
    "unload_region",
    "unload_country",
    "unload_port",
    "unload_terminal",
    "load_date",
    "unload_date",
    "load_region",
    "load_country",
    "load_port",
    "load_terminal",
    "passage_time",
    "group",
    "group_product",
    "category",
    "grade",
    "quantity",
    "vessel_type",
    "vessel_class",
    "cargo_status",
    "via_geofence",
)


def match_cargo(
    passages: DataFrame,
    cargo: DataFrame,
    date_col: str = "unload_date",
    max_days: int = CARGO_TOLERANCE_DAYS,
    partition_by: Sequence[str] = ("vessel_key", "passage_time"),
    cargo_tie: Sequence[str] = (),
    passage_tie: Sequence[str] = (),
    between: tuple | None = None,
    ordered: bool = False,
) -> DataFrame:
    """The cargo whose date is nearest to each passage, before or after it.

    Only cargo at most ``max_days`` midnights away counts; a passage without any
    keeps null cargo columns. One row remains per ``partition_by``, so passages
    of one vessel at the same moment collapse unless ``geofence`` is added.
    Equal distances are settled by ``cargo_tie``, equal passages by
    ``passage_tie``, nulls first, and beyond these by all output columns in
    order, so the result does not depend on row order. ``between`` limits the
    passages to those of its first to last date; cargo that these cannot reach is
    left out at the scan.

    The distance depends on calendar days only. Cargo is first reduced to the best row of each vessel
    day and passages to their days, which the calendar bounds however many rows a
    vessel has. Both lie on one timeline per vessel, on which one pass in each direction carries the
    nearest cargo row along, so that no pairs are compared and cargo is moved once.
    """
    if date_col not in JOIN_DATES:
        raise ValueError(f"unknown date column {date_col!r}, expected one of {JOIN_DATES}")
    if not {"vessel_key", "passage_time"} <= set(partition_by):
        raise ValueError("partition_by must contain vessel_key and passage_time")

    candidates = cargo.where(F.col("vessel_imo").isNotNull() & F.col(date_col).isNotNull())
    if between is not None:
        passages = passages.where(
            within_dates(
                F.col("passage_time"), passages.schema["passage_time"].dataType, *map(as_date, between)
            )
        )
        reach = dt.timedelta(days=max_days)
        candidates = candidates.where(
            within_dates(
                F.col(date_col),
                cargo.schema[date_col].dataType,
                as_date(between[0]) - reach,
                as_date(between[1]) + reach,
            )
        )
    others = [name for name in PASSAGE_COLUMNS if name not in partition_by]
    passage_order = list(dict.fromkeys([*passage_tie, *others]))
    single = _first_per_group(passages, partition_by, passage_order)
    passage_days = single.select("vessel_key", F.to_date("passage_time").alias("day")).dropna().distinct()

    cargo_order = list(dict.fromkeys([*cargo_tie, *CARGO_COLUMNS]))
    dated = candidates.withColumn("day", F.to_date(date_col))
    cargo_days = _first_per_group(dated, ["vessel_imo", "day"], cargo_order).select(
        F.col("vessel_imo").alias("vessel_key"),
        "day",
        # As a struct, rows compare by these columns in order, nulls first.
        F.struct(*[F.col(f"`{name}`") for name in cargo_order]).alias("cargo"),
    )
    winners = _nearest_cargo(passage_days, cargo_days, max_days).select(
        "vessel_key", "passage_day", "gap", *[F.col(f"cargo.`{name}`") for name in CARGO_COLUMNS]
    )

    single, winners = single.alias("single"), winners.alias("winners")
    matched = single.join(
        winners,
        (F.col("single.vessel_key") == F.col("winners.vessel_key"))
        & (F.to_date("single.passage_time") == F.col("winners.passage_day")),
        "left",
    ).select(
        *[f"single.{name}" for name in PASSAGE_COLUMNS],
        F.col("winners.gap").alias("date_diff"),
        *[f"winners.`{name}`" for name in CARGO_COLUMNS],
    )
    matched = matched.select(*[f"`{name}`" for name in MATCHED_COLUMNS])
    return matched.orderBy(*partition_by) if ordered else matched


def _first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group by ``order``, nulls first."""
    ranking = Window.partitionBy(*by).orderBy(*[F.asc_nulls_first(f"`{name}`") for name in order])
    return df.withColumn("_rank", F.row_number().over(ranking)).where("_rank = 1").drop("_rank")


def _nearest_cargo(passage_days: DataFrame, cargo_days: DataFrame, max_days: int) -> DataFrame:
    """The cargo row nearest to each passage day and their ``gap``; of two as near, the lesser row."""
    timeline = cargo_days.withColumn("cargo_day", F.col("day")).unionByName(
        passage_days.withColumn("passage_day", F.col("day")), allowMissingColumns=True
    )
    # Cargo sorts before the passages of its day in both directions.
    cargo_first = F.asc_nulls_first("passage_day")
    vessel = Window.partitionBy("vessel_key")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    upwards = vessel.orderBy("day", cargo_first).rowsBetween(*so_far)
    downwards = vessel.orderBy(F.desc("day"), cargo_first).rowsBetween(*so_far)
    found = F.when(F.col("cargo_day").isNotNull(), F.struct("cargo_day", "cargo"))
    reached = (
        timeline.withColumn("_found", found)
        .withColumn("before", F.last("_found", ignorenulls=True).over(upwards))
        .withColumn("after", F.last("_found", ignorenulls=True).over(downwards))
        .where(F.col("passage_day").isNotNull())
    )
    before = F.date_diff("passage_day", F.col("before.cargo_day"))
    after = F.date_diff(F.col("after.cargo_day"), "passage_day")
    gap = F.least(before, after)
    # The lesser of two rows as near; where they are one row, it is either.
    nearest = F.least(
        F.when(before == gap, F.col("before.cargo")), F.when(after == gap, F.col("after.cargo"))
    )
    return reached.where(gap <= max_days).select("vessel_key", "passage_day", gap.alias("gap"), nearest.alias("cargo"))
