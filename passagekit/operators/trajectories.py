"""Positions around passages and the lines drawn through them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagekit.functions.compass import bearing
from passagekit.functions.dates import as_date, within_dates
from passagekit.plans.bands import day_band_join
from passagekit.plans.parts import bounded_parts

TRAJECTORY_TOLERANCE_DAYS = 14
MAX_POINTS_PER_ROW = 100_000


POSITION_COLUMNS = ("vessel_key", "latitude", "longitude", "dt_pos_utc")


def _of_dates(passages: DataFrame, between: tuple | None) -> DataFrame:
    if between is None:
        return passages
    return passages.where(
        within_dates(
            F.col("passage_time"), passages.schema["passage_time"].dataType, *map(as_date, between)
        )
    )


def _within_reach(positions: DataFrame, max_days: int, between: tuple | None) -> DataFrame:
    if between is None:
        return positions
    reach = dt.timedelta(days=max_days)
    return positions.where(
        within_dates(
            F.col("dt_pos_utc"),
            positions.schema["dt_pos_utc"].dataType,
            as_date(between[0]) - reach,
            as_date(between[1]) + reach,
        )
    )


def positions_near_passages(
    positions: DataFrame,
    passages: DataFrame,
    max_days: int = TRAJECTORY_TOLERANCE_DAYS,
    between: tuple | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Every position within ``max_days`` of a passage of the same vessel.

    A position near several passages appears once for each. ``between`` limits
    the passages to those of its first to last date; positions that these cannot
    reach are left out at the scan.
    """
    near = day_band_join(
        _within_reach(positions, max_days, between).select(*POSITION_COLUMNS, *keep),
        _of_dates(passages, between).select("vessel_key", "geofence", "passage_time"),
        "vessel_key",
        "dt_pos_utc",
        "passage_time",
        max_days,
    )
    return near.select(
        "vessel_key", "geofence", "passage_time", "latitude", "longitude", "dt_pos_utc", *keep
    )


def counted_positions(
    positions: DataFrame,
    passages: DataFrame,
    by: Sequence[str] = ("vessel_key",),
    max_days: int = TRAJECTORY_TOLERANCE_DAYS,
    between: tuple | None = None,
) -> DataFrame:
    """Positions near passages, once per line, with the number of these passages.

    Gives the lines of :func:`positions_near_passages` without its pairs. Each
    passage adds one to its line from ``max_days`` before its day to ``max_days``
    after it. The running total of these steps tells how many passages reach a
    day, and each position looks up its own day. The work grows with the
    positions and the calendar, whatever the number of passages. Output columns
    are ``by``, the position and ``copies``.
    """
    line = list(dict.fromkeys(["vessel_key", *by]))
    day = F.to_date("passage_time")
    first = F.struct(F.date_sub(day, max_days).alias("day"), F.lit(1).alias("step"))
    past = F.struct(F.date_add(day, max_days + 1).alias("day"), F.lit(-1).alias("step"))
    steps = (
        _of_dates(passages, between)
        .where(F.col("passage_time").isNotNull())
        .select(*line, F.inline(F.array(first, past)))
        .groupBy(*line, "day")
        .agg(F.sum("step").alias("step"))
    )
    in_order = Window.partitionBy(*line).orderBy("day")
    copies_per_day = (
        steps.withColumn("copies", F.sum("step").over(in_order))
        .withColumn("until", F.lead("day").over(in_order))
        .where(F.col("copies") > 0)
        .select(*line, "copies", F.explode(F.sequence("day", F.date_sub("until", 1))).alias("_day"))
    )
    points = _within_reach(positions, max_days, between).select(
        *POSITION_COLUMNS, F.to_date("dt_pos_utc").alias("_day")
    )
    return points.join(copies_per_day, ["vessel_key", "_day"]).select(
        *line, *POSITION_COLUMNS[1:], "copies"
    )


def distinct_points(points: DataFrame, by: Sequence[str] = ("vessel_key",)) -> DataFrame:
    """Each position once per line, however many passages it is near to."""
    return points.select(*by, "dt_pos_utc", "longitude", "latitude").distinct()


def trajectory_lines(
    points: DataFrame,
    by: Sequence[str] = ("vessel_key",),
    time_format: str = "yyyy-MM-dd HH:mm:ss",
    max_points: int = MAX_POINTS_PER_ROW,
    copies: str | None = None,
) -> DataFrame:
    """One line per vessel: its coordinates and times in time order.

    Output columns are ``by``, ``part``, ``n_points``, ``coordinates`` (array of
    [lon, lat]) and ``dates``. A line is drawn in parts of at most ``max_points``
    (two or more) points, so that no row and no task has to hold an unbounded line.
    Each part begins with the last point of the part before, so the parts join up; only
    a line of one point has a part of one point. Points
    without a key in ``by`` belong to no line. ``copies`` names a column that
    says how often a point occurs, see :func:`counted_positions`.
    """
    if max_points < 2:
        raise ValueError(f"a part of a line needs two points at least, not {max_points}")
    keyed = points.dropna(subset=list(by))
    parts = bounded_parts(
        keyed,
        by=by,
        order=("dt_pos_utc", "longitude", "latitude"),
        # Points without a time sort first.
        cell=F.coalesce(F.date_trunc("hour", F.col("dt_pos_utc")), F.lit(dt.datetime(1, 1, 1))),
        max_rows=max_points,
        copies=None if copies is None else F.col(copies),
        overlap=1,
    )
    ordered = F.sort_array(
        F.collect_list(F.struct("dt_pos_utc", "longitude", "latitude", "copies"))
    )
    return (
        parts.groupBy(*by, "part")
        .agg(ordered.alias("_steps"))
        .select(
            *by,
            "part",
            F.flatten(
                F.transform("_steps", lambda step: F.array_repeat(step, step["copies"]))
            ).alias("_steps"),
        )
        .select(
            *by,
            "part",
            F.size("_steps").alias("n_points"),
            F.transform(
                "_steps", lambda step: F.array(step["longitude"], step["latitude"])
            ).alias("coordinates"),
            F.transform(
                "_steps", lambda step: F.date_format(step["dt_pos_utc"], time_format)
            ).alias("dates"),
        )
        # The last point of a full part alone is no part of its own.
        .where((F.col("part") == 0) | (F.col("n_points") > 1))
    )


def line_ends(parts: DataFrame, by: Sequence[str] = ("vessel_key",)) -> DataFrame:
    """One row per line of :func:`trajectory_lines`: ``n_points`` and ``ends``, its first and last point."""
    at = lambda place: F.get("coordinates", place)
    ends = parts.groupBy(*by).agg(
        # Parts share the point where they meet.
        (F.sum("n_points") - F.count(F.lit(1)) + 1).cast("int").alias("n_points"),
        F.min_by(at(F.lit(0)), "part").alias("_first"),
        F.max_by(at(F.size("coordinates") - 1), "part").alias("_last"),
    )
    points = F.when(F.col("n_points") > 1, F.array("_first", "_last")).otherwise(F.array("_first"))
    return ends.select(*by, "n_points", points.alias("ends"))


def line_headings(
    lines: DataFrame, coordinates: str = "coordinates", points: str | None = None
) -> DataFrame:
    """Heading from the first to the last point of each line, with its report texts.

    Adds ``heading``, ``heading_text`` (one decimal), ``start_text`` and
    ``end_text`` (six decimals) and ``total_points``. They are null for a line
    of fewer than two points. For lines in parts take the ``ends`` of
    :func:`line_ends` as coordinates and its ``n_points`` as ``points``.
    """
    line = F.col(coordinates)
    first, last = F.get(line, F.lit(0)), F.get(line, F.size(line) - 1)
    drawable = F.size(line) >= 2
    point_text = lambda point: F.format_string("[%.6f, %.6f]", point[0], point[1])
    return (
        lines.withColumn(
            "heading",
            F.when(
                drawable, bearing(F.get(first, F.lit(0)), F.get(first, F.lit(1)),
                                  F.get(last, F.lit(0)), F.get(last, F.lit(1)))
            ),
        )
        .withColumn("heading_text", F.when(drawable, F.format_string("%.1f", "heading")))
        .withColumn("start_text", F.when(drawable, point_text(first)))
        .withColumn("end_text", F.when(drawable, point_text(last)))
        .withColumn("total_points", F.when(drawable, F.size(line) if points is None else F.col(points)))
    )
